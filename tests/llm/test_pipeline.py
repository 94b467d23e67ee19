"""The pipeline against a plain version of its stages."""

import math
import random
from collections import Counter

from echoloom.llm import pii, quality
from echoloom.llm.queries import KEY

from test_pairs_of_documents import brute_components


def make(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def plain_weights(tokens, entropy=0.9, repeats=2.0):
    """Tempered shares: the smallest exponent by plain bisection for each aim, and the larger of the two."""
    total = sum(tokens.values())
    u = [t / total for t in tokens.values() if t]

    def weights(a):
        z = sum(x**a for x in u)
        return [x**a / z for x in u]

    aims = [
        lambda a: -sum(w * math.log(w) for w in weights(a)) <= entropy * math.log(len(u)) + 1e-12,
        lambda a: min(u) ** (a - 1) / sum(x**a for x in u) <= repeats * (1 + 1e-12),
    ]
    best = 0.0
    for aim in aims:
        low, high = 0.0, 1.0
        if aim(0.0):
            continue
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if aim(middle) else (middle, high)
        best = max(best, high)
    z = sum(x**best for x in u)
    return {s: (t / total) ** best / z if t else 0.0 for s, t in tokens.items()}


def check_mixture(clean, mixed):
    """Each source has its weight of all words: whole passes, and a last one that is cut where the next document is too long."""
    words = {i: len((t or "").split()) for i, (t, _) in clean.items()}
    tokens = Counter()
    for i, (_, s) in clean.items():
        tokens[s] += words[i]
    weight, copies, total = plain_weights(tokens), Counter(mixed), sum(tokens.values())
    for s, n in tokens.items():
        mine = [i for i, (_, o) in clean.items() if o == s]
        quota = weight[s] * total
        passes = math.floor(quota / n + 1e-9) if n else 1
        assert all(copies[i] in (passes, passes + 1) for i in mine)
        extra = [words[i] for i in mine if copies[i] == passes + 1]
        rest = quota - passes * n
        assert sum(extra) <= rest + 1e-6 and (rest - sum(extra) < max(words[i] for i in mine) or len(extra) == len(mine))
    assert set(copies) <= set(clean)


def test_stages(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(3)
    words = "the of and to in that it was he for on with as his they be at one have this from or had by".split() + ["v" + chr(97 + j % 26) + chr(97 + j // 26) + "n" for j in range(300)]
    texts = [" ".join(rng.choices(words[:24], k=20) + rng.choices(words, k=60)) for _ in range(120)]
    texts += [t.replace(" was ", " wasnt ", 1) for t in texts[:30]] + [texts[5]] * 3 + [texts[0] + " mail ann.lee7@corp.example.com now"]
    texts += ["zz%%% yy$$$ xx### ww&&& " * 15 + str(k) for k in range(12)]
    rows = [(k, t, "en", f"s{k % 3 and k % 2}", len(t)) for k, t in enumerate(texts)] + [(900, "", "en", None, 0), (901, None, None, None, None)]
    folder = make(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit_quality(docs)
    good = [r for r in rows if quality.score_text(r[1], model.weights, {})[0] >= 0.5]
    assert not any("%%%" in (r[1] or "") for r in good) and sum(r[0] < 154 for r in good) == 154
    components = brute_components([(r[0], r[1]) for r in good], 5)
    kept = [r for r in good if components[r[0]][1] == r[0]]
    p = pii.Pseudonymizer(KEY)
    clean = {r[0]: (p.replace(r[1])[0], r[3]) for r in kept}
    steps = docs
    for k, (name, stage) in enumerate(c.STAGES):
        steps = stage(spark, steps, folder)
        steps.write.parquet(str(tmp_path / f"out{k}"))
        steps = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert steps.columns == docs.columns
        if name == "quality":
            assert sorted(r["doc_id"] for r in steps.collect()) == sorted(r[0] for r in good)
        if name == "near_dedup":
            assert sorted(r["doc_id"] for r in steps.collect()) == sorted(r[0] for r in kept)
        if name == "pii":
            assert {r["doc_id"]: (r["text"], r["source"]) for r in steps.collect()} == clean and "ann.lee7" not in str(clean)
        if name == "mixing":
            mixed = sorted(r["doc_id"] for r in steps.collect())
            check_mixture(clean, mixed)
    assert sorted(r["doc_id"] for r in steps.collect()) == mixed
    assert sorted(r["doc_id"] for r in c.run(spark, folder).collect()) == mixed


def test_empty(spark, tmp_path):
    import corpus_pipeline as c

    assert c.run(spark, make(spark, tmp_path, [])).count() == 0
