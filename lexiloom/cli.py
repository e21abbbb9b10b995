"""python -m lexiloom bench TOKENIZER FILES...: how fast files are encoded, and whether another library agrees."""

from __future__ import annotations

import argparse
import json
import os
import platform
import re
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.evaluate import first_bytes
from .sources.readers import TextSource, resolve
from .tokenizer import Tokenizer

UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}


def parse_size(text: str) -> int | None:
    """'100MB', '2.5GB' or '1000000'; 'none' is no limit."""
    s = text.strip().lower()
    if s in ("none", "unlimited"):
        return None
    m = re.fullmatch(r"([0-9]+(?:[.][0-9]+)?)\s*([kmgt]?)i?b?", s)
    if not m:
        raise argparse.ArgumentTypeError(f"{text!r} is no size; write 100MB, or none")
    return int(float(m[1]) * UNITS[m[2]])


def load(name: str, scheme: str | None) -> Tokenizer:
    return Tokenizer.from_tiktoken(name, scheme) if name.endswith(".tiktoken") else Tokenizer(name)


def report(name: str, seconds: float, size: int, tokens: int) -> None:
    print(f"{name:>9}: {seconds:8.3f} s, {size / 1e6:10.2f} MB at {size / 1e6 / seconds:8.2f} MB/s, {tokens / 1e6:8.2f} million tokens at {tokens / 1e6 / seconds:7.2f}")


def bench(a: argparse.Namespace) -> int:
    spark = SparkSession.builder.appName("lexiloom bench").getOrCreate()
    print(f"{'cpu':>9}: {platform.processor() or platform.machine()}, {os.cpu_count()} threads")
    tok = load(a.tokenizer, a.pretokenizer)
    source = TextSource(a.files, a.doc_separator) if a.doc_separator else resolve(a.files)
    docs = source.documents(spark)
    if not a.stream_from_disk:
        docs = docs.cache()
        docs.count()
    size = sum(os.path.getsize(f) for f in a.files)
    began = time.perf_counter()
    tokens = tok.encode_df(docs).agg(F.sum(F.size("ids"))).first()[0] or 0
    seconds = time.perf_counter() - began
    report("lexiloom", seconds, size, tokens)
    if not (a.compare_to or a.validate):
        return 0
    if tok.config is None:
        print("a comparison takes a tokenizer with a tokenizer.json", file=sys.stderr)
        return 1
    try:
        import tokenizers
    except ImportError:
        print("a comparison takes the tokenizers library", file=sys.stderr)
        return 1
    texts = [r["text"] for r in first_bytes(docs, a.comparison_limit).orderBy("doc_id").select("text").collect()]
    if not texts:
        print("the limit leaves no text to compare", file=sys.stderr)
        return 1
    other = tokenizers.Tokenizer.from_str(json.dumps(tok.config))
    began = time.perf_counter()
    theirs = [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
    other_seconds = time.perf_counter() - began
    n = sum(len(t.encode()) for t in texts)
    report("hf", other_seconds, n, sum(map(len, theirs)))
    print(f"speed against hf: {(size / seconds) / (n / other_seconds):.2f}")
    if a.validate:
        for k, (x, y) in enumerate(zip(tok.encode_batch_list(texts), theirs)):
            if x != y:
                at = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
                print(f"document {k} differs at token {at}: {x[at : at + 5]} and {y[at : at + 5]}, lengths {len(x)} and {len(y)}", file=sys.stderr)
                return 1
        print(f"all {len(texts)} documents agree")
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexiloom", description=__doc__)
    b = p.add_subparsers(dest="command", required=True).add_parser("bench")
    b.add_argument("tokenizer")
    b.add_argument("files", nargs="+")
    b.add_argument("--stream-from-disk", action="store_true", help="count the reading as well")
    b.add_argument("--compare-to", choices=["hf"])
    b.add_argument("--comparison-limit", type=parse_size, default=parse_size("100MB"))
    b.add_argument("--validate", action="store_true")
    b.add_argument("--doc-separator")
    b.add_argument("--pretokenizer")
    return bench(p.parse_args(args))
