"""Documents with fewer words than a benchmark item."""

import random

from sleuthframe.llm import decontam

from .test_filters import FOLD, WORD, shingles


def test_texts_shorter_than_the_item(spark):
    rng = random.Random(3)
    items = [(n, " ".join(rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(n))) for n in (3, 5, 8, 9, 10, 14, 31, 59)] + [(60, "x y " * 7)]
    docs = []
    for _, text in items:
        words = text.split()
        docs += [" ".join(words[a : len(words) - b]) for a in range(4) for b in range(9)] + [" ".join([*words[:-4], "other", words[-1]])]
    docs = [(i, t and t.upper()) for i, t in enumerate([*docs, "", None, "x y " * 6])]
    want = set()
    for d, text in docs:
        w = WORD.findall((text or "").translate(FOLD))
        for item, body in items:
            v = body.split()
            for s in range(max(1, len(w) - len(v) + 1)) if w else ():
                a, b = shingles(w[s : s + len(v)]), shingles(v)
                if 5 * sum((a & b).values()) >= 4 * sum((a | b).values()):
                    want.add((d, item))
    table, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(df, table).collect()}
    assert set(found) == want
    near = next(i for i, t in docs if t == " ".join(items[7][1].upper().split()[:-3]))
    assert (found[near, 59]["similarity"], found[near, 59]["first_word"], found[near, 59]["n_words"]) == (52 / 55, 0, 56)
    assert {r["doc_id"] for r in decontam.clean(df, table).collect()} == {d for d, _ in docs} - {d for d, _ in want}
