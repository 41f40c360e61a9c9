"""The pipeline against a chain of brute-force stages."""

import hashlib
import re

from test_near_dedup import brute
from tokenizers import Tokenizer

import corpus_pipeline
from lattiq.llm.common import table
from lattiq.llm.queries import tokenizer_path


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = out.cache()
        kept[name] = [r["doc_id"] for r in docs.collect()]
    good = kept["quality_classifier"]
    assert 0.5 * len(rows) < len(good) < len(rows)

    groups: dict[str, list] = {}
    for i in good:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", rows[i]["text"] or ""), []).append(i)
    exact = {min(g, key=lambda i: (-len(rows[i]["text"] or ""), i)) for g in groups.values()}
    assert set(kept["exact_dedup"]) == exact
    near = {i for i, (_, c) in brute([(i, rows[i]["text"]) for i in sorted(exact)], 80).items() if i == c}
    assert set(kept["near_dedup"]) == near
    assert sorted(kept["mixing"]) == sorted(near)

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tok.no_truncation(), tok.no_padding()
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == near and len(got) == len(near)
    for r in got:
        ids = tok.encode(rows[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_guard_without_the_subpackage(spark, tmp_path):
    """With the llm folders and the pipeline gone, everything else is there."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "lattiq", tmp_path / "lattiq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith(('op1_', 'pipeline'))]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_result_keeps_the_mixture(spark, odd_docs):
    """Positions after encoding are those of the mixture, whatever the order of the rows."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    mixed = corpus_pipeline.mixture(spark, docs, sf).collect()
    out = corpus_pipeline.encoding(spark, docs.repartition(7), sf).collect()
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["position"])] == [r["doc_id"] for r in mixed]
    odd = corpus_pipeline.encoding(spark, odd_docs, sf).collect()
    assert sorted(r["position"] for r in odd) == list(range(odd_docs.count()))


def test_odd_and_empty_tables(spark, odd_docs, tmp_path):
    """Every stage and the whole run take odd rows, clashing names and no rows at all."""
    docs = odd_docs.selectExpr("*", "1 AS key", "2 AS position_", "3 AS _sha", "4 AS gone")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, None), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "odd" / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "odd"))
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.exact_copies(spark, docs, "").count() < docs.count()
    docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
