"""The classifier by held-out accuracy, the rules against plain Python."""

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm import quality_classifier as qc
from textloom.llm import quality_rules as qr


def test_held_out_accuracy(documents, labels):
    rows = qc.classify(documents, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    assert np.mean([a > b for a in good for b in bad]) >= 0.9
    assert sum(r["predicted"] for r in held if r["quality"]) >= 0.9 * len(good)


def test_additive_model_learns_pairs():
    rng = np.random.default_rng(11)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = qc.fit(x, y).score(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.9


def plain_features(text):
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x]
    chars, n = max(1, len(text)), max(1, len(words))
    held = lambda pattern: len(regex.findall(pattern, text))
    return {
        "words": math.log1p(len(words)), "word_length": sum(map(len, words)) / n, "distinct_words": len(set(words)) / n,
        "symbols": held(r"[#*$%&<>@^~_=+\\/]") / chars, "bars": text.count("|") / chars, "shouts": text.count("!") / chars,
        "stops": text.count(".") / n, "commas": text.count(",") / n, "upper": held(r"\p{Lu}") / chars, "digits": held("[0-9]") / chars,
        "other": held(r"[^\p{L}\x20\x09-\x0D.,]") / chars, "line_words": math.log1p(n / max(1, len(lines))), "distinct_lines": len(set(lines)) / max(1, len(lines)),
    }


def plain_score(model, text):
    """The score of a text, feature by feature and pair by pair."""
    x = list(plain_features(text).values())
    total = model.intercept + sum(t[bisect_right(list(e), v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
    total += sum(t[bisect_right(list(a), x[i]), bisect_right(list(b), x[j])] for i, j, a, b, t in model.pairs)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_scores_against_plain_python(documents, clashing, labels):
    model = qc.train(documents, labels)
    assert model.pairs and list(qc.features()) == list(plain_features(""))
    for df in (documents, clashing):
        for r in qc.score(df, model, "text").collect():
            assert abs(r["score"] - plain_score(model, r["text"])) < 1e-9, r["text"]


def test_one_label_and_no_rows():
    assert (qc.fit(np.zeros((3, 2)), np.ones(3)).score(np.zeros((2, 2))) == 0.8).all()
    assert (qc.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((2, 2))) == 0.5).all()


def test_odd_rows(spark, clashing, labels, nothing):
    none = labels.limit(0)
    rows = qc.classify(clashing, labels).collect()
    assert len(rows) == clashing.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert {r["score"] for r in qc.classify(clashing, none).collect()} == {0.5}
    assert qc.classify(nothing, labels).count() == 0
    assert qr.quality_rules(clashing, none).where("score <> 0 OR (NOT base_failed AND NOT kept)").count() == 0
    assert qr.quality_rules(nothing, labels).count() == 0


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules(documents, clashing, labels):
    for df in (documents, clashing):
        want = sorted(repr((r["doc_id"], *plain(r["text"]))) for r in df.select("doc_id", "text").collect())
        got = qr.quality_rules(df, labels).collect()
        assert sorted(repr((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in got) == want


def test_ratio_keeps_good_and_drops_junk(spark):
    good = [(i, " ".join(f"{a}ing {b}ed" for a in "abcdefgh" for b in "klmnop"[i % 4 :]), 1) for i in range(300)]
    junk = [(1000 + i, " ".join(f"{a}{i % 7}### {b}***" for a in "abcdefgh" for b in "klmno"), 0) for i in range(100)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string, quality int")
    rows = qr.quality_rules(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()
    assert all(r["score"] > -0.1 for r in rows if r["doc_id"] < 1000) and all(r["score"] < -0.3 and not r["kept"] for r in rows if r["doc_id"] >= 1000)


def test_scores_against_plain_counts(spark, documents, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    def buckets(t):
        found = [w.encode() for w in words(t)]
        return [zlib.crc32(g) % qr.N_BUCKETS for g in found + [a + b" " + b for a, b in zip([b"", *found], found)]]

    trusted = {r["trusted_id"] for r in qr.trusted_ids(labels).collect()}
    raw, good = Counter(), Counter()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for i, t in texts.items():
        raw.update(buckets(t))
        if i in trusted:
            good.update(buckets(t))
    share = sum(good.values()) / sum(raw.values())
    weight = {b: np.float32(np.log((good[b] + qr.SHRINK) / (raw[b] * share + qr.SHRINK))) for b in raw}
    for r in qr.quality_rules(documents, labels).where(F.col("n_words") > 0).collect():
        found = buckets(texts[r["doc_id"]])
        assert abs(r["score"] - np.mean([weight[b] for b in found])) < 1e-4


def test_all_good_documents_are_counted(spark, clashing, monkeypatch):
    """Both joins mark the same rows."""
    labels = spark.range(20_500).selectExpr("id AS doc_id", "1 AS quality").union(spark.sql("SELECT 7L, 0"))
    assert qr.trusted_ids(labels).count() == 20_499
    docs = clashing.select("doc_id", "text").union(spark.range(15, 20_500).selectExpr("id", "concat('good text of ', id)"))
    small = sorted(map(repr, qr.with_trusted(docs, labels).collect()))
    assert sum("trusted_id=None" not in r for r in small) == docs.where("doc_id BETWEEN 0 AND 20499 AND doc_id <> 7").count()
    monkeypatch.setattr(qr, "BROADCAST_IDS", 0)
    assert sorted(map(repr, qr.with_trusted(docs, labels).collect())) == small


def test_no_table_is_stored(spark, clashing, labels):
    """Each stored table is a file a partition, and each file starts processes in the executors, so the rules store none."""
    before = list(common.WRITTEN)
    assert qr.quality_rules(clashing, labels).count() == clashing.count()
    assert common.WRITTEN == before


def test_grams_are_made_once_by_compiled_code(spark, documents, labels, capsys):
    texts = documents.select(F.lit(1).cast("long").alias("good"), common.words_of().alias("words"))
    qr.buckets(texts).groupBy("bucket").count().explain()
    plan = capsys.readouterr().out
    assert "lambda" not in plan and plan.count("split(") == 1


def test_repeated_windows_by_number_of_pairs(spark, labels):
    """Texts at the edge of what is looked at for windows: pairs repeated three and four times, runs of one word, blank lines."""
    five, other = "a b c d e", [f"w{i}" for i in range(20)]
    texts = [
        f"{five} x {five}", f"a b c d x {five}", f"a b x b c x c d x d e x {five}", f"{five} {five}", "a " * 5, "a " * 6, "a " * 30, "a b " * 10,
        " ".join([*other[:12], *five.split(), *other[12:], *five.split()]), "x\n \nx\n \n\n\t\nx y\n", "# a\n#* b\n# a", "\u00e9\u00e9 \U0001f600|\n" * 3,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = qr.quality_rules(df, labels).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
