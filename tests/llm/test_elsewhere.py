"""The operators that send models to tasks run where workers have no copy of the package: another folder, no PYTHONPATH."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from lagweave.llm import binary_packing, decontaminate, quality_crf, ranked_search, spelling, tokens, toxicity, url_filter
from lagweave.llm.queries import URL_RULES
texts = ["a good line of words here\\nand one more of them" + f" w{{i}}" if i % 2 else "#### $$$$ ||||" for i in range(60)]
docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
items = spark.createDataFrame([(1, "good line of words here and one")], "item_id long, text string")
field = quality_crf.fit(docs, labels)
print("rows", quality_crf.classify(docs, field).count(), quality_crf.accepted(docs, field).columns,
      toxicity.score_documents(docs, toxicity.fit(docs, labels)).count(), decontaminate.contaminated_pairs(docs, items).count(),
      decontaminate.decontaminated(docs, items).count(),
      url_filter.filter_urls(docs.selectExpr("'http://a.net/' as url"), URL_RULES).where("verdict = 'block'").count(),
      ranked_search.search(docs, items, 3).count(), spelling.group_variants(docs).count() >= 0,
      binary_packing.binary_sequences(docs, tokens.default_path("byte_bpe_50k.json")).select("doc_id").distinct().count())
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows 60 ['doc_id', 'text', 'lang'] 60 30 30 60 3 True 60" in run.stdout, run.stdout + run.stderr[-3000:]
