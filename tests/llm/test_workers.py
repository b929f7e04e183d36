"""Functions of the operators run where the package is not installed."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from replyloom.session import get_spark
spark = get_spark("workers", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
for name in ("op2_packing", "op3_credentials", "op4_ngram_lm", "op7_token_counts", "op8_simhash", "op9_block_topk", "op10_chunk_bpe",
             "op11_whitening", "op12_phrases", "op13_piece_words"):
    assert entry.queries()[name](spark, entry.SMOKE_DIR).count() > 0
print("done")
"""


def test_queries_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    run = subprocess.run([sys.executable, "-c", SCRIPT, repo], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
