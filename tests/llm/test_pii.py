import hashlib
import re

import numpy as np

from scimetrics.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None,
    "",
    "a@b.c x.y+z@host.example.com@again.org a@@b.c @x.y a@b é@x.yz",
    "1.2.3.4 256.1.1.1 1.2.3 1.2.3.4.5.6.7.8 0001.02.3.255. 10.20.30.4000 1.1.1.1.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 4012888888881881x 1-2-3",
    "+1 (904) 555-2259, +12 345 +123456789 +1 2 3 4 5 6 7 8 9 + 123456789 +1.(...)9 +1234567890123456",
    "😀 call +44 20 7946 0958 or mail jo@ex.org from 192.168.0.1\nnext",
    "9" * 50_000 + " " + "a" * 50_000 + "@",
]


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((rank, m.start(), m.end()))
    return found


def test_base_spans():
    for text in TEXTS[:-1]:
        assert pii.base_spans(text or "") == brute(text)
    assert pii.base_spans(TEXTS[-1]) == []


def test_query_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[6], 1), (6, TEXTS[6], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int")
    crf = pii.train(df)
    got = pii.digests(pii.find_personal_data(df, crf)).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text, _ in rows:
        spans = brute(text)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want.append((doc_id, *[sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    for r in got:
        base = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute(TEXTS[r.doc_id if r.doc_id is not None else 6])]
        assert set(base) <= set(r.spans.split(","))
    assert pii.digests(pii.find_personal_data(df.limit(0), crf)).collect() == []


def test_crf_learns_shapes(spark):
    rows = [(i, f"word other {i}.thing and user{i}.{i}@mail{i}.example.com more text here") for i in range(200)]
    rows += [(1000 + i, f"plain words stand here {i} without anything") for i in range(200)]
    crf = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    words = pii.read_words(["something with user7.9@mail3.example.com inside", "plain words stand here"])
    states = crf.decode(pii.shape_features(words), pii.lines(words))
    assert states.tolist() == [0, 0, 1, 0, 0, 0, 0, 0]


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    crf = pii.Crf(
        rng.standard_normal((pii.FIELDS * pii.SLOTS, pii.STATES)).astype(np.float32),
        rng.standard_normal((pii.STATES, pii.STATES)),
        rng.standard_normal(pii.STATES),
    )
    words = pii.read_words(["a 1 B\nc@d\n\nx y z 4", "q"])
    slots, cuts = pii.shape_features(words), pii.lines(words)
    got, scores = crf.decode(slots, cuts), crf.scores(slots)
    from itertools import product

    for a, b in zip(cuts[:-1], cuts[1:]):
        def total(path, a=a):
            return crf.start[path[0]] + sum(scores[a + i, s] for i, s in enumerate(path)) + sum(
                crf.move[s, t] for s, t in zip(path, path[1:])
            )

        best = max(product(range(pii.STATES), repeat=b - a), key=total)
        assert abs(total(best) - total(tuple(got[a:b]))) < 1e-4


def test_spans_follow_from_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    docs = docs.sort_values("doc_id").head(120)
    odd = ["555-2259", "9045552259", "call\n555-2259\nnow", "+1 904", "", "\n\n", "555-2259"]
    texts = [t or "" for t in docs["text"]] + odd
    together = pii.shape_features(pii.read_words(texts))
    alone = [pii.shape_features(pii.read_words([t])) for t in texts]
    assert np.array_equal(together, np.concatenate(alone))
    backwards = pii.shape_features(pii.read_words(texts[::-1]))
    assert np.array_equal(backwards, np.concatenate(alone[::-1]))
    crf = pii.train(spark.createDataFrame(docs))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {}
    for placed in (rows.coalesce(1), rows.repartition(7), rows.orderBy("text").coalesce(1)):
        spans = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find_personal_data(placed, crf)).collect()}
        assert spans == (found or spans)
        found = spans
