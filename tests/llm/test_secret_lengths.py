"""Very long runs and texts with very many spans: no crash, time in proportion."""

import random
import string
import time

import pytest

from palimpsest.llm import secrets

from . import brute

RNG = random.Random(8)
BASE64 = "".join(RNG.choice(string.ascii_letters + string.digits + "+/") for _ in range(1_000_000))
TEXTS = [
    "aaBB11" + "-" * 1_000_000,
    "aaBB11" + "-_/" * 300_000 + "a1B2" * 20,
    BASE64,
    " ".join("0123456789abcdef" * 2 for _ in range(10_000)),
    " ".join("".join(RNG.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(10_000)),
    "token=" * 100_000,
    "password" + " " * 500_000 + "x",
]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_long(spark, i):
    docs = spark.createDataFrame([(i, TEXTS[i])], "doc_id long, text string")
    began = time.time()
    (row,) = secrets.scan_secrets(docs).collect()
    assert tuple(row)[1:5] == brute.base_secrets(TEXTS[i])[:4]
    (kept,) = secrets.redact(docs).collect()
    assert time.time() - began < 60
    if i == 2:
        assert row.spans == "entropy_base64:0:1000000" and kept.text == "[SECRET]"
    if i == 4:
        assert row.spans.count("entropy_hex") > 9_000 and kept.text.count("[SECRET]") > 9_000
    if i in (0, 6):
        assert row.spans == "" and kept.text == TEXTS[i]
