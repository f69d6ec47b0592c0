import importlib

from test_near import ITEMS, contained, edited, groups
from test_tokens import check_pieces

import corpus_pipeline
from tickloom.llm import language, near_dedup, secrets


def test_stages_against_plain_code(spark, docs_of, shared, sentences, odd, tmp_path):
    items = [(k, sentences(900 + k, 30)) for k in range(5)]
    texts = edited(sentences, 10, 60) + odd + [sentences(300, 80) + " " + items[2][1], items[4][1], sentences(301, 50) + " token=abcdefgh12 end"]
    docs = docs_of([*list(enumerate(texts)), (0, texts[0]), (None, texts[1])])
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")

    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.identified(spark, now, folder)
    assert kept.columns == now.columns
    model = language.train(now)
    want = sorted((r.doc_id or 0, r.text) for r in language.identify(now, model).where("not rejected").collect())
    kept = kept.cache()
    rows = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert rows == want and all(any(c.isalpha() for c in t) for _, t in rows)
    assert {t for t in texts if len((t or "").split()) > 20} <= {t for _, t in rows}

    one = corpus_pipeline.without_near_copies(spark, kept, folder)
    # A null id goes last: it stays only where it is alone.
    order = sorted(set((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()))
    root, _ = groups([t for _, _, t in order], 5)
    want = sorted((i, t) for k, (_, i, t) in enumerate(order) if root[k] == k)
    assert sorted((r.doc_id or 0, r.text) for r in one.collect()) == want

    free = corpus_pipeline.decontaminated(spark, one, folder)
    held = {d for d, *_ in contained(want, items)}
    want = [(i, t) for i, t in want if i not in held]
    assert len(held) >= 2 and sorted((r.doc_id, r.text) for r in free.collect()) == want

    masked = corpus_pipeline.redacted(spark, free, folder)
    want = [(i, t.replace("token=abcdefgh12", "[SECRET]")) for i, t in want]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in masked.collect()) == [(i, t, len(t)) for i, t in want]
    assert masked.columns == now.columns

    check_pieces(corpus_pipeline.packed(spark, masked, folder).collect(), want, 2048)
    run = corpus_pipeline.run(spark, folder).collect()
    check_pieces(run, want, 2048)


def test_empty_table(spark, docs_of, shared, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_its_query():
    queries = importlib.import_module("tickloom.llm.queries")
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "secrets", "packing"]
    assert near_dedup.FUNCTIONS >= 16 * near_dedup.DEPTH and secrets.RULES[: len(secrets.BASE)] == secrets.BASE
