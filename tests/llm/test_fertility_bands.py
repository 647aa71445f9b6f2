"""Fertility and entropy decide by themselves, by language and script."""

import base64
import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from sleuthframe.llm import quality

from ..conftest import SMALL

RUSSIAN = "Москва является столицей России и крупнейшим городом страны. Население города составляет более двенадцати миллионов человек, что делает его одним из самых больших городов Европы. Здесь находятся многие музеи и театры, университеты и научные институты, а также правительство. Каждый год сюда приезжают туристы со всего мира, чтобы увидеть старые улицы, парки, площади и большую реку, которая проходит через весь город."
KOREAN = "서울은 대한민국의 수도이며 가장 큰 도시이다. 이 도시에는 많은 사람들이 살고 있으며 매년 세계 여러 나라에서 관광객이 찾아온다. 한강은 도시의 가운데를 흐르고 주변에는 공원과 산이 많다. 사람들은 주말에 가족과 함께 산에 오르거나 강가에서 자전거를 탄다. 오래된 궁궐과 시장도 있고 새로운 건물과 큰 회사도 많아서 옛날과 지금을 함께 볼 수 있다. 봄에는 꽃이 피고 가을에는 단풍이 아름답다."
ENGLISH = "The committee met on Tuesday to discuss the proposal for a new library building in the center of town. Several members said that the cost was too high, while others argued that the old building could no longer serve the growing number of readers who visit every day, and repairs would be needed soon."


def test_noise_is_rejected_and_other_scripts_are_kept(spark):
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 10))) for _ in range(300)) for a in (string.ascii_lowercase, "bcdfghjklmnpqrstvwxz")]
    noise += ["\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(80)), RUSSIAN.encode().decode("latin-1")]
    texts = [*noise, RUSSIAN, KOREAN, ENGLISH]
    docs = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts) for lang in (None, "en", "ru")], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["base_failed"], r["kept"]) for r in quality.score(docs, bands=quality.PRIORS).collect()}
    assert got == {(i, False, i >= len(noise)) for i in range(len(texts))}


def test_each_measure_rejects(spark):
    """Counts of rejections by measure, and noise that only one of them is out for."""
    folder = SMALL.replace("0.001", "0.01")
    scored = quality.score(spark.read.parquet(f"{folder}/documents.parquet")).filter("not base_failed").cache()
    n = scored.count()
    by = {m: scored.filter(F.array_contains(F.split("outside", ","), m)).count() for m in quality.MEASURES}
    assert all(0.02 * n < by[m] < 0.12 * n for m in ("piece", "multi", "entropy")) and by["byte_share"] <= 0.01 * n
    assert scored.filter("kept <> (outside = '')").count() == 0
    scored.unpersist()
    cases = {"byte_share": RUSSIAN.encode().decode("latin-1").replace("\x85", "x").replace("\xa0", "x"), "entropy": " ".join(["the cat and dog"] * 4 + ENGLISH.split()[:6]) + " the cat and the dog" * 10}
    docs = spark.createDataFrame([(k, t, None) for k, t in cases.items()], "doc_id string, text string, lang string")
    for r in quality.score(docs, bands=quality.PRIORS).collect():
        assert r["doc_id"] in r["outside"].split(","), r


def independent_bands(rows):
    """Quantiles and limits in plain Python: by language, over the rows that pass the base rules."""
    out = {}
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        for m in ("piece", "multi", "byte_share", "entropy"):
            values = sorted(measure(r)[m] for r in own)
            q = [values[max(0, math.ceil(p * len(values)) - 1)] for p in (0.25, 0.5, 0.75)]
            spread = max((q[2] - q[0]) / 1.349, {"piece": 0.025 * q[1], "multi": 0.025 * q[1], "byte_share": 0.005, "entropy": 0.01 * q[1]}[m])
            low, high = {"piece": (1.58, 5.5), "multi": (1.70, 5.5), "byte_share": (0.0, 0.05), "entropy": (4.70, 5.65)}[m]
            fitted = [(len(own) * (q[1] + side * 7 * spread) + 30 * p) / (len(own) + 30) for side, p in ((-1, low), (1, high))]
            # Only the sides of noise are fitted, and never wider than the prior.
            out[lang, m] = (low if m == "byte_share" else max(low, fitted[0]), min(high, fitted[1]) if m == "byte_share" else high)
    return out


def measure(r):
    return {"piece": r["n_letters"] / r["n_tokens"], "multi": r["n_letters"] / r["n_multi_tokens"], "byte_share": r["n_multi_byte_tokens"] / r["n_multi_tokens"], "entropy": r["window_entropy"]}


def test_verdict_equals_brute_force(spark):
    """Tokens, entropy and bands made anew for each text, word by word."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(docs)).collect()}
    piece, multi = (quality.fertility(f"{quality.TOKENIZERS}/{v}") for v in (quality.VOCABULARY, quality.MULTI))
    known, rows = {}, []
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        if got[d["doc_id"]]["base_failed"]:
            continue
        for w in words:
            if w not in known:
                known[w] = piece.encode([w])[0], multi.encode([w])[0]
        ids = [i for w in words for i in known[w][1]]
        starts = [min(k, max(len(ids) - 50, 0)) for k in range(0, len(ids), 50)]
        entropy = [-sum(c / 50 * math.log2(c / 50) for c in Counter(ids[s : s + 50]).values()) for s in starts]
        letters = sum(len(re.findall(rb"[0-9A-Za-z\xC3-\xC9]|[\xCD-\xED]", w.encode())) for w in words)
        rows.append({"doc_id": d["doc_id"], "lang": d["lang"], "n_letters": letters, "n_tokens": sum(len(known[w][0]) for w in words), "n_multi_tokens": len(ids), "n_multi_byte_tokens": sum(bool(multi.is_byte[i]) for i in ids), "window_entropy": sum(entropy) / len(entropy)})
    bands = independent_bands(rows)
    kept = {r["doc_id"] for r in rows if all(bands[r["lang"], m][0] - 1e-12 <= v <= bands[r["lang"], m][1] + 1e-12 for m, v in measure(r).items())}
    assert {i for i, r in got.items() if r["kept"]} == kept and len(kept) < len(rows)


def test_window_entropy_does_not_depend_on_length(spark):
    docs = spark.createDataFrame([(n, " ".join([ENGLISH] * n)) for n in (1, 30)], "doc_id long, text string")
    one, many = (r["window_entropy"] for r in quality.score(docs, bands=quality.PRIORS).orderBy("doc_id").collect())
    assert abs(one - many) < 0.1


PROSE = {
    "en": ENGLISH,
    "de": "Der Gemeinderat hat am Dienstag beschlossen, die alte Brücke über den Fluss im kommenden Frühjahr zu erneuern. Die Arbeiten sollen etwa acht Monate dauern, und der Verkehr wird in dieser Zeit über die nördliche Straße geleitet. Viele Händler in der Innenstadt fürchten, dass weniger Kunden kommen, während Anwohner hoffen, dass es in ihren Straßen endlich ruhiger wird und die Kinder sicherer zur Schule gehen können.",
    "fr": "Le musée de la ville rouvrira ses portes au mois de septembre après deux années de travaux. Les visiteurs pourront y découvrir une nouvelle salle consacrée aux peintres de la région, ainsi qu'un jardin où l'on servira le thé pendant la belle saison. La directrice a expliqué que le prix des billets ne changerait pas, et que les enfants entreraient toujours gratuitement avec leurs parents.",
    "es": "La cosecha de este año ha sido mejor de lo que esperaban los agricultores del valle, gracias a las lluvias que llegaron a finales de abril. Sin embargo, muchos de ellos se quejan de que el precio que reciben por la fruta apenas cubre los gastos, y piden al gobierno que ayude a las familias que todavía viven del campo y que no quieren marcharse a la ciudad.",
}


def test_natural_prose_stays_in_a_corpus_of_other_texts(spark):
    """Letters a token of real prose lie far above this corpus' own; that is no noise."""
    folder = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    noise = " ".join("".join(random.Random(i).choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for i in range(120))
    own = spark.createDataFrame([(-i - 1, t, lang) for i, (t, lang) in enumerate([*((t, k) for k, t in PROSE.items()), (noise, "en")])], docs.schema)
    got = {r["doc_id"]: (r["base_failed"], r["kept"], r["outside"]) for r in quality.score(docs.unionByName(own)).filter("doc_id < 0").collect()}
    assert all(got[-i - 1] == (False, True, "") for i in range(len(PROSE))), got
    assert got[-len(PROSE) - 1][1] is False


def test_a_language_of_junk_does_not_make_junk_the_norm(spark):
    rng = random.Random(5)
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(90)) for _ in range(60)]
    docs = spark.createDataFrame([*((i, t, "xx") for i, t in enumerate(junk)), (99, ENGLISH, "xx")], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in quality.keep(docs).collect()] == [99]


def test_bands_of_any_number_of_languages(spark, monkeypatch):
    """Rare languages have their own band too, whether it is broadcast or joined by shuffle."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.concat("lang", (F.col("doc_id") % 7).cast("string")).alias("lang"))
    rows = lambda: sorted((r["doc_id"], r["kept"], r["outside"]) for r in quality.score(docs).collect())
    want = rows()
    for bound in (0, 1, 5):
        monkeypatch.setattr(quality, "BROADCAST_BANDS", bound)
        assert rows() == want
