"""License scans by canonical digest (native: SQL functions only).

A text is normalised (case, punctuation, copyright lines, equivalent spellings, white
space) and the SHA-256 of the *whole* canonical text is hash-joined to the digests of
known licences.  The scan is one pass over the text in the JVM; only (id, digest) rows
meet the licence table, which is broadcast if its size is under a checked bound and
joined by shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a licence table that may be broadcast: 64 hex digits and a name each, some 20 MB.
BROADCAST_ROWS = 100_000

# The equivalent spellings of the public SPDX matching guidelines, as rules on letters.
# White space and hyphens are gone by then (sub-license, non-commercial, per cent), c and z are s
# (licence, organization), so that each rule is one literal replacement in the JVM.
FOLDED = ("ABCDEFGHIJKLMNOPQRSTUVWXYZcz", "absdefghijklmnopqrstuvwxysss")
EQUIVALENTS: tuple[tuple[str, str], ...] = (
    ("ou", "o"),  # favour
    ("dgement", "dgment"),  # acknowledgement
    ("analogue", "analog"),
    ("ll", "l"),  # wilful, fulfilment
    ("sopyrightowner", "sopyrightholder"),
    ("sopyrightholders", "sopyrightholder"),
    ("https", "http"),
)

# Published licence texts and the usual one-line grants.
LINES: dict[str, str] = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
LICENCES: dict[str, str] = {
    "MIT": "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS,
    "ISC": f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}",
    "0BSD": f"Zero-Clause BSD\n{_ISC_GRANT}.\n{_ISC_WARRANTY}",
    "BSD-2-Clause": "BSD 2-Clause License\n" + _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": "BSD 3-Clause License\n" + _BSD + _BSD_3 + _BSD_WARRANTY,
    **LINES,
}

#: The same texts under other usual titles or none.
VARIANTS: list[tuple[str, str]] = [
    (k, title + LICENCES[k].split("\n", 1)[1])
    for k, titles in {"MIT": ("", "The MIT License\n", "The MIT License (MIT)\n", "MIT License (MIT)\n"), "ISC": ("", "The ISC License\n"), "0BSD": ("", "BSD Zero Clause License\n"), "BSD-2-Clause": ("", "The BSD 2-Clause License\n", "The 2-Clause BSD License\n", "BSD 2-Clause \"Simplified\" License\n"), "BSD-3-Clause": ("", "The BSD 3-Clause License\n", "The 3-Clause BSD License\n", "BSD 3-Clause \"New\" or \"Revised\" License\n")}.items()
    for title in titles
]

#: Digests (whole, without wider notices, and the same up to the end of the terms) of the published full texts.
FULL_TEXTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("5834c9cda70350250de2a00adf8e87ca27df956df6e85bc28fc17008c0c78689", "fadf7f86164ea8e952529d11c29df7adee39e90ae8d8d918d025dfbeaee4a63d", "d032923cfe8a27a18a8d9fb21d947fc9842b0c7bb7fd40110035e22483c4724f", "952c55a7df8f7383e7761442d9ed186eb14c0e9ba5ed3fe9947a86bb07a7a5bb",),
    "Artistic-1.0-Perl": ("b99c1f4351f8414f0ddaf68249c47c54be453e155344fe7191554573c797bb1a",),
    "CC0-1.0": ("a9a14e9e9ca64db77d536e17b2946ec5f801a0ce04866f6021439bd37de81fc9",),
    "GFDL-1.2": ("d37780cb0575f6d0a303579f9ac0998b8ca258c789a7a6deb6bab90bca06e070", "2144998185d4ce1b1d266079e51da0d0320b41c4a836295d5c1bf54e2d7bc01d",),
    "GFDL-1.3": ("756cd01ef99c22686d0898e088f13534cc176d002e3ce805b706e996a0f6202c", "6260a7865c4161f4b9fe7d65bba33f7a2307b3cefea5abc8ed22acd4df29eda6",),
    "GPL-1.0": ("83240c3c2fb882423fc0f67651171598e3c3b059686fda88ea63f4ef0b5859dd", "444eec41e2133254e1b8bc69a6f9d9f57c9f3d4e624651f88f9a282e76bdba5e", "70518e3d4138be0dcad0cd0e6d0bb6f80526b12ba3fef9cb7b9e7af8607567c7",),
    "GPL-2.0": ("becd9f742551e2b250a301c41f616e7723cd202096441eddafd35f4736f3ec56", "092016ecc7fd26d5830348853e14f92b7734c370e0f6962d75774f5bce88fe35", "292aa11310bb63834687a16cf8a2763cf8f0bf49027f55a712d28d53ae862816",),
    "GPL-3.0": ("3166ec838c4e4daf8050cee208d20c471133af681d47ac1c45d5730b7133a080", "4be530ef802868894a516c7e5a83c1c03e179abc4d1ebc86ff5264b2ebc7ca14", "003504222105ef97404b319e1883a957e350902d6729c99dca60c9e5a7b112bc",),
    "LGPL-2.0": ("e299534f2d2d63f4dd4741334103c7439d76d309843edde8f0dc3cb093f5cbc4", "3c3cc183c3882ac9635f607648ab22fb0945d86ebb9d6af3f779871ce480a20d", "d4c4836e297dffff0d2aa83ed2ed2bf9344702e89b474db013c78c4e319d03c4",),
    "LGPL-2.1": ("7e9ee49159b17b07e860795b6ec54411c7a6552a3d58475539bcce429b8cc2df", "130006a878b63d38fbfded74a4f4ac79449188df9a1870c827e801de36d0ace1", "4b7105e55e17804ee9c0ef1c8166810bc90dc8266f13342b090f9936c46a9aa8",),
    "LGPL-3.0": ("94b9452dc90861ea5267d7539203b97ef758cc8da605336e0025ef0a758b43a4",),
    "MPL-1.1": ("ee5855e386c59e09a0246f1946fdc57aa22f3930977ab61ac7fceff4ef78254d", "ec00544fe8a1e2e3d764e0c3ad7f27143a63d5e9f5906310765c12cd72856dec",),
    "MPL-2.0": ("10100befda3b47b4192d3a58fbd230c3842a34cf650c7d71a56c4aab86e22e14", "cf043f9b7780804db0745ac3733e3348638b7ccfd84fca0c498443158dee46e9",),
}


#: Notices: a line that starts with a copyright mark and holds a year.
_NOTICE = r"(?mi)^[\x20\t]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$"
_PUNCTUATION = r"[^A-Za-z0-9\x80-\x{10FFFF}]+"


#: Notices of a wider kind, after comment signs or without a year, and lines of nothing but reserved rights.
_WIDE_NOTICE = (
    r"(?m)^[\x20\t#*/;!%\-]*(?:(?i:copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*"
    r"|(?:(?i:copyright)[\x20\t:]*(?i:\(c\)|©)|\([cC]\)|©)[^\n]*"
    r"|Copyright[\x20\t]+(?:by[\x20\t]+)?(?:\[|<|\{|[A-Z])[^\n]*"
    r"|(?i:all rights reserved)[.\x20\t]*)\r?$"
)
#: Lines that speak of copyright rather than claim it: their first letter is lowered, so that they are no notice.
_NO_NOTICE = r"(?m)^([\x20\t#*/;!%\-]*)Copyright([\x20\t]+(?:by[\x20\t]+)?(?:License|Licence|Law|Holder|Owner|Notice|Act|Treat|Disclaimer|Statement|Interest|Right))"


def canonical_wide(text: Column) -> Column:
    """``canonical`` of the text without notices of the wider kind; null where it has none."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), _NO_NOTICE, "$1copyright$2")
    return F.when(text.rlike(_WIDE_NOTICE), canonical(F.regexp_replace(text, _WIDE_NOTICE, "")))


def canonical_wide_sql(text: str) -> str:
    """``canonical_wide`` for DuckDB."""
    text = f"regexp_replace(coalesce({text}, ''), '{_NO_NOTICE}', '\\1copyright\\2', 'g')"
    bare = f"regexp_replace({text}, '{_WIDE_NOTICE}', '', 'g')"
    return f"CASE WHEN regexp_matches({text}, '{_WIDE_NOTICE}') THEN {canonical_sql(bare)} END"


def canonical(text: Column) -> Column:
    """Canonical text: notices, ASCII punctuation and white space dropped, A-Z lower-cased, equivalent spellings unified."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _NOTICE, "")
    out = F.translate(F.regexp_replace(out, _PUNCTUATION, ""), *FOLDED)
    for old, new in EQUIVALENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical_sql(text: str) -> str:
    """``canonical`` for DuckDB."""
    out = f"regexp_replace(coalesce({text}, ''), '{_NOTICE}', '', 'g')"
    out = f"translate(regexp_replace({out}, '{_PUNCTUATION}', '', 'g'), '{FOLDED[0]}', '{FOLDED[1]}')"
    for old, new in EQUIVALENTS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def digests(spark: SparkSession, licences: Mapping[str, str] = LICENCES) -> DataFrame:
    """(license_id, digest) of known licences; of licences with equal canonical texts the first name stays."""
    table = spark.createDataFrame(list(licences.items()), "license_id string, text string")
    return table.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the registered query: ``LICENCES``, their ``VARIANTS``, and ``FULL_TEXTS``, which are kept as digests."""
    rows = [*LICENCES.items(), *VARIANTS]
    texts = spark.createDataFrame(rows, "license_id string, text string")
    every = [texts.select("license_id", F.sha2(c, 256).alias("digest")) for c in (canonical(F.col("text")), canonical_wide(F.col("text")))]
    full = spark.createDataFrame([(k, d) for k, ds in FULL_TEXTS.items() for d in ds], "license_id string, digest string")
    return every[0].union(every[1]).union(full).filter("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license_id) for each row: license_id is null where the text is no known licence.

    A text is looked up as it is and, if it has notices after comment signs or without a
    year, without those; ``digest`` is that of the former.
    ``known`` is (license_id, digest) with unique digests.  Null and empty texts, and texts
    of nothing but notices and punctuation, have the digest of the empty text and no
    licence.  Equal texts each get their row; other columns of ``docs`` are not read.
    """
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.sha2(canonical_wide(F.col("text")), 256).alias("__wide"))
    table = known.select(F.col("digest").alias("__d"), "license_id").filter(F.col("__d") != F.sha2(F.lit(""), 256))
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    rows = rows.join(table, F.col("digest") == F.col("__d"), "left").select("doc_id", "digest", "__wide", "license_id")
    wide = table.select(F.col("__d").alias("__v"), F.col("license_id").alias("__id"))
    return rows.join(wide, F.col("__wide") == F.col("__v"), "left").select("doc_id", "digest", F.coalesce("license_id", "__id").alias("license_id"))


def scan_sql() -> str:
    """``scan`` of documents for the table of ``known``, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    texts = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in [*LICENCES.items(), *VARIANTS])
    full = ", ".join(f"('{k}', '{d}')" for k, ds in FULL_TEXTS.items() for d in ds)
    return f"""
    WITH raw(license_id, text) AS (VALUES {texts}),
    every AS (SELECT license_id, sha256({canonical_sql("text")}) AS digest FROM raw UNION ALL SELECT license_id, sha256({canonical_wide_sql("text")}) FROM raw UNION ALL VALUES {full}),
    known AS (SELECT digest, min(license_id) AS license_id FROM every WHERE digest IS NOT NULL AND digest <> sha256('') GROUP BY digest),
    docs AS (SELECT doc_id, sha256({canonical_sql("text")}) AS digest, sha256({canonical_wide_sql("text")}) AS wide FROM documents)
    SELECT doc_id, docs.digest, coalesce(k.license_id, w.license_id) AS license_id
    FROM docs LEFT JOIN known k ON docs.digest = k.digest LEFT JOIN known w ON docs.wide = w.digest"""
