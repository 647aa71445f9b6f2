"""Keys inside encodings of texts, containers, and bodies behind signs of comments and quotes."""

import base64
import struct
import textwrap

import pytest

from sleuthframe.llm import secrets

from .test_filters import der, pkcs1

KEY = pkcs1(200)
BODY = textwrap.wrap(base64.b64encode(KEY).decode(), 64)
PEM = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(BODY) + "\n-----END RSA PRIVATE KEY-----\n"
PUBLIC = der(0x30, der(0x30, der(0x06, bytes.fromhex("2a864886f70d010101")), der(0x05)), der(0x03, bytes(100)))
PUBLIC_PEM = "-----BEGIN PUBLIC KEY-----\n" + "\n".join(textwrap.wrap(base64.b64encode(PUBLIC).decode(), 64)) + "\n-----END PUBLIC KEY-----\n"
b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def keys(text):
    return [(s, e, k) for s, e, k in secrets.find(text) if k in ("der", "ssh")]


def test_base64_of_a_key_file():
    line = b64(PEM)
    text = f"users:\n- name: admin\n  user:\n    client-key-data: {line}\n    token\n    other: words\n"
    ((s, e, kind),) = keys(text)
    assert kind == "der" and text[s:e] == line
    assert keys(b64("prefix text of some length before the key, then\n" + PEM))
    assert [k for _, _, k in keys("\n".join(textwrap.wrap(line, 76)) + "\nThis is the next line")] == ["der"]


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_encodings_inside_each_other(depth):
    text = KEY
    for _ in range(depth):
        text = b64(text)
    assert bool(keys(f"value: {text}\n")) is (depth <= secrets.DEPTH)


def test_public_texts_are_left():
    for body in (b64(PUBLIC_PEM), b64(PUBLIC), b64(b64(PUBLIC)), b64("just some ordinary text that was encoded for no reason at all, and more of it " * 5)):
        assert keys(f"data: {body}\n") == []


def test_pkcs12_containers():
    content = der(0x30, der(0x06, bytes.fromhex("2a864886f70d010701")), der(0xA0, der(0x04, bytes(80))))
    mac = der(0x30, der(0x30, der(0x30, der(0x06, bytes.fromhex("2b0e03021a")), der(0x05)), der(0x04, bytes(20))), der(0x04, bytes(8)))
    for parts in ((der(0x02, b"\3"), content), (der(0x02, b"\3"), content, mac)):
        assert [k for _, _, k in keys("keystore = " + b64(der(0x30, *parts)))] == ["der"]
    assert keys("x = " + b64(der(0x30, der(0x02, b"\2"), content))) == []


def openssh(n):
    field = lambda x: struct.pack(">I", len(x)) + x
    public = field(field(b"ssh-ed25519") + field(bytes(32)))
    private = b"\1\2\3\4" * 2 + bytes(range(200))
    return b"openssh-key-v1\x00" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", n) + public * n + field(private)


@pytest.mark.parametrize("n", [1, 16, 17, 40, 300])
def test_containers_of_any_number_of_keys(n):
    body = textwrap.wrap(b64(openssh(n)), 70)
    text = "-----BEGIN OPENSSH PRIVATE KEY-----\n" + "\n".join(body) + "\n-----END OPENSSH PRIVATE KEY-----"
    assert [k for _, _, k in keys(text)] == ["ssh"]


@pytest.mark.parametrize("join", ["\n# ", "\n    // ", "\n * ", "\n> ", '"\n    "', '" +\n  "', "' + \n'", '\\n" +\n  "', '\\n"\n+ "', "\\n", "\r\n", "\n\t"])
def test_bodies_in_comments_and_joined_quotes(join):
    text = "start " + join.join(BODY) + " end"
    ((s, e, kind),) = keys(text)
    assert kind == "der" and text[s:e] == join.join(BODY)
    assert "[SECRET]" in secrets.redacted(text) and BODY[1] not in secrets.redacted(text)


def test_long_texts_of_candidates_take_little_time():
    import time

    began = time.time()
    secrets.find("\n".join(["b3BlbnNzaC1rZXktdjEA" + "A" * 44] * 8_000))
    secrets.find("\n".join([b64("plain text that decodes to plain text of a line, line after line")] * 8_000))
    assert time.time() - began < 20
