"""Times the headline queries: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from quillstone.operators.citations import Scanner
from quillstone.registry import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = (
    "bm25_topk bm25_per_group budget_window chunk_paragraphs content_words_overlap norm_whitespace tokens_letter_digit sentence_split_simple span_outermost span_sweep_segments "
    "priority_merge nearest_binding asof_backward valid_time_lookup longest_prefix forward_fill_state leakage_overlap conflicting_pairs components bin_pack stratified_sample "
    "threshold_search breakdown_grouping_sets pool_chunks policy_three vocab_prune gaps_and_islands extract_citations html_blocks"
).split()


def extraction_rate(chars: int = 244_800) -> int:
    """Characters a second that one thread searches for citations, in text full of them."""
    line = "Enligt 3 kap. 2 § avtalslagen gäller att parterna är bundna, se NJA 2013 s. 502. "
    text, scanner = line * (chars // len(line)), Scanner()
    began = time.perf_counter()
    scanner.parse(text)
    return round(len(text) / (time.perf_counter() - began))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    rate = extraction_rate()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "extraction_chars_per_sec": rate, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
