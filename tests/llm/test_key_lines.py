"""Keys in base64 with other lines around them, short last lines and the URL alphabet."""

import base64

import pytest

from sleuthframe.llm import secrets

from .test_filters import der, pkcs1


def key(n):
    return base64.b64encode(pkcs1(n)).decode()


def field(x):
    return len(x).to_bytes(4, "big") + x


SSH = base64.b64encode(field(b"ssh-ed25519") + field(bytes(range(32)))).decode()
OPENSSH = base64.b64encode(b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + b"\0\0\0\1" + field(field(b"ssh-ed25519") + field(bytes(32))) + field(b"abcdabcd" + bytes(96))).decode()


@pytest.mark.parametrize("width", [40, 64, 65, 76, 5000])
def test_every_length_of_key_wrapped(width):
    for n in range(140, 240):
        for k in (key(n), key(n).rstrip("=")):
            for end in ("\n-----END RSA PRIVATE KEY-----", "\n" if k.endswith("=") else "\nThis is text"):
                body = "\n".join(k[i : i + width] for i in range(0, len(k), width))
                text = f"-----BEGIN RSA PRIVATE KEY-----\n{body}{end}"
                assert secrets.find(text) == [(32, 32 + len(body), "der")], (n, text)
                assert body[:40] not in secrets.redacted(text)


def test_containers_end_where_their_fields_do():
    k = OPENSSH.rstrip("=")
    assert secrets.find(f"{k}\nThis\nis text") == [(0, len(k), "ssh")]


def test_url_alphabet_and_keys_on_consecutive_lines():
    url = base64.urlsafe_b64encode(der(0x30, der(0x02, b"\1"), der(0x04, bytes([1, *[0xFB] * 90])))).decode().rstrip("=")
    assert "-" in url and "_" in url
    assert secrets.find(f"x {url} y") == [(2, 2 + len(url), "der")]
    one, two = key(150).rstrip("="), key(151).rstrip("=")
    text = "\n".join(["A" * 60, one, two, "word", OPENSSH.rstrip("="), "end"])
    assert [k for _, _, k in secrets.find(text)] == ["der", "der", "ssh"]
    assert secrets.redacted(text) == "\n".join(["A" * 60, "[SECRET]", "[SECRET]", "word", "[SECRET]", "end"])


RSA = der(0x06, bytes.fromhex("2a864886f70d010101")) + b"\x05\0"
PBES2 = der(0x06, bytes.fromhex("2a864886f70d01050d"))
SECRET = {
    "pkcs1": pkcs1(129),
    "pkcs8": der(0x30, der(0x02, b"\0"), der(0x30, RSA), der(0x04, pkcs1(129))),
    "pkcs8 of ed25519": der(0x30, der(0x02, b"\0"), der(0x30, der(0x06, bytes.fromhex("2b6570"))), der(0x04, der(0x04, bytes(range(32))))),
    "pkcs8 encrypted": der(0x30, der(0x30, PBES2, der(0x30, b"")), der(0x04, bytes(range(200)))),
    "sec1": der(0x30, der(0x02, b"\1"), der(0x04, bytes(range(32))), der(0xA0, der(0x06, bytes.fromhex("2a8648ce3d030107"))), der(0xA1, der(0x03, b"\0" + bytes(65)))),
    "dsa": der(0x30, der(0x02, b"\0"), *[der(0x02, bytes(range(1, 30)))] * 5),
}
PUBLIC = {
    "spki": der(0x30, der(0x30, RSA), der(0x03, b"\0" + bytes(140))),
    "pkcs1 public": der(0x30, der(0x02, bytes(range(1, 120))), der(0x02, b"\1\0\1")),
    "certificate": der(0x30, der(0x30, der(0xA0, der(0x02, b"\2")), der(0x02, b"\1"), der(0x30, RSA)), der(0x30, RSA), der(0x03, b"\0" + bytes(128))),
    "numbers": der(0x30, *[der(0x02, bytes(range(1, 40)))] * 3),
    "other algorithm": der(0x30, der(0x30, RSA), der(0x04, bytes(100))),
}


@pytest.mark.parametrize("name", [*SECRET, *PUBLIC])
def test_private_keys_only(name):
    """Plain and wrapped, with and without padding, in hex, after a path, indented, with written breaks, before text."""
    data = (SECRET | PUBLIC)[name]
    raw = base64.b64encode(data).decode()
    wanted = ["der"] if name in SECRET else []
    for k in {raw, raw.rstrip("=")}:
        lines = [k[i : i + 64] for i in range(0, len(k), 64)]
        for text in (k, "\n".join(lines), f"path/{k}", f"see /a/b/{k}\n", "    " + "\n    ".join(lines), "-----BEGIN KEY-----\\n" + "\\n".join(lines) + "\\n-----END KEY-----", "\\r\\n".join(lines), f"{k}\nname = x", "\r\n".join(lines)):
            found = secrets.find(text)
            assert [x for _, _, x in found] == wanted, text
            assert all(text[s:e].startswith(k[:10]) and text[s:e].rstrip("=").endswith(k.rstrip("=")[-5:]) for s, e, _ in found)
    assert [x for _, _, x in secrets.find(data.hex()) if x != "hex"] == wanted


def test_public_and_broken_ssh_blobs_are_left():
    whole = base64.b64decode(OPENSSH)
    for blob in (base64.b64decode(SSH), whole[:-1], whole + b"x", whole.replace(b"abcdabcd", b"abcdabce"), whole.replace(b"ssh-ed", b"tls-ed"), b"openssh-key-v1\0" + b"\xff" * 80):
        assert secrets.find(base64.b64encode(blob).decode()) == []


def test_hostile_texts_are_quick():
    import time

    began = time.perf_counter()
    for text in ("/MIIE" * 200_000, "MIIE" * 250_000, ("b3BlbnNzaC1rZXktdjEA" * 3 + "\n") * 15_000, "A.B" * 300_000, "ey." * 300_000):
        secrets.find(text)
    assert time.perf_counter() - began < 20
