import re
from pathlib import Path

from quern.llm import workers


def _mb():
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_free_memory_goes_back_to_the_system():
    many = [bytes(1000) for _ in range(200_000)]
    last = bytes(1000)  # above the others, so that they don't end the heap
    full = _mb()
    del many
    workers.trim()
    assert _mb() < full - 150 and last
