"""Chunks of the packing tokenizer: their ids with a small cache, and the memory that a worker keeps for them."""

import os
import random
import subprocess
import sys

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from seriesloom.llm import packing
from seriesloom.llm.packing import ChunkEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_with_a_small_cache(monkeypatch):
    """Chunks that leave the cache and come back, words with marks, odd and long chunks, of both string types."""
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 40, raising=False)
    library, mine = Tokenizer.from_file(PATH), ChunkEncoder(PATH)
    rng = random.Random(8)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["Élan", "ÄÖÜ", "İx", "ſt", "a\tb", "x\r", "日本語", "é", "12.5", "...", ".", "?!", "a.b.", "don't", "Über" * 30, "z" * 60 + ".", "q" * 48, "q" * 48 + "!", "ﷺ", ""]
    texts = [None, "", " ", "\n"] + [" ".join(w + rng.choice(["", "", ".", ",", "!", "?", "?!"]) for w in rng.choices(words, k=30)) for _ in range(60)]
    for start in range(0, len(texts), 8):
        part = texts[start : start + 8]
        ids, ends = mine.encode(pa.array(part, pa.large_string() if start % 16 else pa.string()))
        assert len(ends) == len(part) and ends[-1] == len(ids)
        for text, s, e in zip(part, [0, *ends], ends):
            assert ids[s:e].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_memory_of_a_worker():
    """240,000 different words: what Python and Arrow keep of them, in a process of its own."""
    code = (
        "import tracemalloc\n"
        "import pyarrow as pa, public_tokenizers\n"
        "from seriesloom.llm.packing import ChunkEncoder\n"
        "enc = ChunkEncoder(public_tokenizers.path('word_bpe_49k.json'))\n"
        "word = lambda n: ''.join(chr(97 + n // 26**k % 26) for k in range(5))\n"
        "enc.encode(pa.array(['one two.']))\n"
        "before = pa.total_allocated_bytes()\n"
        "tracemalloc.start()\n"
        "for s in range(0, 240_000, 30_000):\n"
        "    enc.encode(pa.array([' '.join(map(word, range(s, s + 30_000)))]))\n"
        "print(tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) < 16e6
