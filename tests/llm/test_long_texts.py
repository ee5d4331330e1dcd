"""Memory of the per-document work on a text of 48 MB, in a process of its own."""

import os
import subprocess
import sys

import pytest

MAKE = """
import random, resource, sys
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(50_000)]
text = " ".join(rng.choices(words, k=7_500_000))
assert len(text) > 48_000_000
"""
WORK = {
    "shingles": "from sitefold.llm import jaccard_join as j; raw = text.encode(); del text; j.band_keys(j.shingles(raw, 3), 22)",
    "language": "from sitefold.llm import language_id as j; j.counts(text); j.words_only(text)",
    "runs": "from sitefold.llm import periodic as j; raw = text.encode(); del text; j.describe(raw)",
}


@pytest.mark.parametrize("name", WORK)
def test_memory(name):
    code = MAKE + WORK[name] + "\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=False, timeout=300,
                         env={**os.environ, "PYTHONPATH": os.pathsep.join(sys.path)})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) < 600  # the text itself, twice, and the interpreter with its libraries are 220
