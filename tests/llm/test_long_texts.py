"""Decontamination of repetitive texts in bounded memory, and over a benchmark of several blocks."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

from sealbook.llm import decontamination
from sealbook.llm.decontamination import Index, contamination, edits, find, normal, sought


def whole_distance(item, text):
    """Fewest edits between the item and any passage of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("meetings", [50, 1 << 19])
@pytest.mark.parametrize("letters", ["a", "ab", "abc ", "abcdefgh "])
def test_all_items_are_found(monkeypatch, letters, meetings):
    monkeypatch.setattr(decontamination, "MEETINGS", meetings)
    draw = random.Random(letters)
    items = [(i, normal("".join(draw.choice(letters) for _ in range(n)))) for i, n in enumerate((20, 25, 40, 60, 90))]
    items = [(i, t) for i, t in [*items, (7, "ab" * 20), (8, "a" * 50)] if sought(t) and len(t) >= decontamination.LEAST_CHARS]
    texts = []
    for _ in range(6):
        passage = list(draw.choice(items)[1])
        for _ in range(draw.randrange(5)):
            passage[draw.randrange(len(passage))] = draw.choice("zab")
        texts.append(normal("".join(draw.choice(letters) for _ in range(40)) + "".join(passage) + " zz"))
    texts += ["", "a" * 90, "ab" * 50]
    wanted = [[(i, d) for i, t in items if (d := whole_distance(t, text)) <= edits(len(t))] for text in texts]
    assert find(texts, Index(items)) == wanted


def test_memory_of_a_repetitive_text():
    code = (
        "import resource\n"
        "from sealbook.llm.decontamination import Index, find\n"
        "index = Index([(1, 'a' * 960), (2, 'a' * 900 + 'b' * 60)])\n"
        "print(find(['a' * 80_000], index) == [[(1, 0), (2, 60)]], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2], timeout=120)
    same, peak = out.stdout.split()
    assert same == "True" and int(peak) < 400


def test_benchmark_of_several_blocks(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(draw.choices(words, k=12))) for i in range(40)] + [(None, "one two three"), (41, None)]
    texts = [" ".join(draw.choices(words, k=30)) for _ in range(20)] + [None, "", "so one two three go"]
    texts += [f"{texts[k]} {items[k][1]} {items[39 - k][1]}" for k in range(8)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (5, texts[5]), (5, texts[-2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, many = (
        sorted(map(str, contamination(docs, benchmark, block_chars=n).collect())) for n in (1_000_000, 150)
    )
    assert one == many and len(one) == len(rows) and sum("contaminated=True" in r for r in one) == 11
