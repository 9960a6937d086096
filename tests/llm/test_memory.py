import subprocess
import sys

CODE = """
import re
import numpy as np
import pyarrow as pa
from pathlib import Path
from hazardspark.llm.common import slices

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

def batches(large):
    for _ in range(4):
        yield pa.record_batch({"n": pa.array(np.arange(1000))})
        if large:  # a large block raises the size that malloc keeps, the small ones stay with it
            np.ones(30 << 17)
            some = [np.ones(1 << 13) for _ in range(600)]
            del some

for _ in slices(batches(False)):
    pass
before = held()
for _ in slices(batches(True)):
    pass
print(held() - before)
"""


def test_a_task_gives_its_memory_back():
    grown = float(subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True).stdout)
    assert grown < 10
