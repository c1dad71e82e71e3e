"""Workers stay for many tasks; what a task took must not stay with them."""

import subprocess
import sys
from pathlib import Path

HELD = """
import re
from pathlib import Path
import numpy as np
from frameloom.llm.common import tidied, tidied_groups
mb = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024
def work(batches):
    for _ in batches:
        small = [np.zeros(12_000, np.uint8) + 1 for _ in range(8_000)]  # below malloc's threshold for maps
        last = np.ones(50, np.uint8)  # keeps the heap's end
        kept.append(last)
        yield len(small)
        del small
kept = []
before = mb()
list(tidied(work)([0]))
assert mb() - before < 30, (before, mb())
tidied_groups(lambda g: g)(None)
"""


def test_a_task_leaves_no_free_memory():
    subprocess.run([sys.executable, "-c", HELD], cwd=Path(__file__).resolve().parents[2], check=True, timeout=100)
