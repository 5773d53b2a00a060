"""The pipeline against a plain version in Python on a small corpus, and its contract."""

import re

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import sentencepiece
from posewright.llm import queries, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    en = "the cat and the other thing went to that place with them on the way home "
    fr = "le chat et une autre chose sont dans la maison avec les enfants pour la nuit "
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        words = (en if i % 2 else fr).split()
        rows.append((i, " ".join(rng.permutation(words * 3)), "en" if i % 2 else "fr", "s", 1))
    leak = "what is the total number of red marbles that remain in the small wooden box"
    rows += [(100, rows[3][1], "en", "s", 1), (101, rows[3][1], "en", "s", 1), (102, "12345 !!! 678", "en", "s", 1), (103, None, None, "s", 0),
             (104, rows[5][1] + " so " + leak + " then " + rows[7][1], "en", "s", 1), (105, "the end of it", None, None, None)]
    long = " ".join(rng.permutation(en.split() * 60))
    return rows + [(106, long, "en", "s", 1), (107, long + " home", "en", "s", 1)], [(1, leak)]


def plain(rows, items):
    kept = {i: t for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    last = {}
    for i, t in kept.items():
        last[t] = max(i, last.get(t, i))
    kept = {i: t for i, t in kept.items() if last[t] == i}
    fps = {i: simhash.fingerprint(t) for i, t in kept.items()}
    label = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    kept = {i: t for i, t in kept.items() if label[i] == i}
    kept = {i: t for i, t in kept.items() if not any(u in t for _, u in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {(i, tuple(library.encode(t))) for i, t in kept.items()}


def test_run_equals_plain_version(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, COLUMNS).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in got} == plain(rows, items) and all(r.round_trip for r in got)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in P.STAGES[:-1]:
        assert step(spark, docs, str(tmp_path)).schema.names == docs.schema.names


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "decontaminate", "sentencepiece"]
