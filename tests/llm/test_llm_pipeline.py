"""The corpus pipeline against a brute-force version in plain Python."""

import sys
from pathlib import Path

import numpy as np
import pytest
from llm_cases import frame, rows

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from test_llm_dedup import naive_components, naive_fingerprint  # noqa: E402
from test_llm_filters import naive_measures, naive_scan  # noqa: E402

from tidings.llm import language_id, quality_rules, queries, sentencepiece_lattice  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def naive_ratio(docs, labels):
    """Log-ratio of every n-gram kind sequence, counted in a dict."""
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1}
    raw, good = np.zeros(1 << quality_rules.BITS), np.zeros(1 << quality_rules.BITS)
    for r in docs:
        for c in quality_rules.cells(r["text"].encode()):
            for x in c.tolist():
                raw[x] += 1
                good[x] += r["doc_id"] in trusted
    share = raw / raw.sum()
    with np.errstate(all="ignore"):
        ratio = np.log((good / good.sum() + quality_rules.PRIOR * share) / ((1 + quality_rules.PRIOR) * share))
    return np.where(raw > 0, ratio, 0)


@pytest.fixture(scope="module")
def brute(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    ratio = naive_ratio(docs, labels)
    kept = []
    for r in docs:
        m = naive_measures(r["text"])
        cells = np.concatenate([*quality_rules.cells(r["text"].encode()), np.zeros(0, int)])
        if m[0] >= 20 and 100 * m[4] <= 30 * m[0] and ratio[cells].mean() >= quality_rules.MIN_SCORE:
            kept.append(r)
    # the classifier is a learned model: its dictionaries are taken from the operator, its use is checked here
    dicts = language_id.dictionaries(spark.createDataFrame(kept, spark.read.parquet(f"{SMALL}/documents.parquet").schema).where(~language_id.held_out()))
    classifier = language_id.Classifier(dicts)
    kept = [r for r in kept if (p := classifier.predict(r["text"]))[0] != "und" and p[1] >= language_id.MIN_MARGIN]
    root = naive_components({r["doc_id"]: naive_fingerprint(r["text"]) for r in kept})
    kept = [r for r in kept if root[r["doc_id"]] == r["doc_id"]]
    items = [(str(b["item_id"]), b["text"]) for b in bench]
    clean = []
    for r in kept:
        n, hit, _ = naive_scan(r["text"], items)
        if not (hit > 0 and 20 * hit >= n):
            clean.append(r)
    return clean


def test_run_equals_brute_force(spark, brute):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_MODEL))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {r["doc_id"]: library.encode(r["text"]) for r in brute}


def test_stages_keep_the_columns_and_take_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns, no rows."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "benchmark decontamination",
                                                     "SentencePiece encoding"]
    for some in (rows(), []):
        docs = frame(spark, some)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            if i < 4:
                assert out.columns == docs.columns and out.count() <= len(some)
            else:
                assert out.count() == len(some) and out.columns == [c.split()[0] for c in sentencepiece_lattice.ENCODED.split(", ")]


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy of the repository without the folder and the pipeline still imports."""
    import shutil
    import subprocess

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "tidings", tmp_path / "tidings", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 100 and not any(k.startswith('op1_') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
