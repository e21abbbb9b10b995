"""Spark-native subword tokenization: corpora, pretokens, vocabularies, encoding."""

from .functions.pretokens import pretoken_counts, pretokenize, safe_ranges, split_documents
from .operators.encode import decode, decode_udf, encode, encode_udf, token_totals
from .operators.post import PadTruncate, SubstringMatcher, forbidden_counts, pad_truncate, patterns_found, wrap_truncate
from .operators.train import Trained, train_bpe, train_superbpe
from .plans.loaders import cached_file, from_json, hub_token, looks_like_repo_id
from .sources.readers import BytesSource, JsonlSource, ParquetSource, Source, TextSource, detect_format
from .tokenizer import SpecialTokenFound, Tokenizer

__version__ = "0.1.0"
__all__ = [
    "BytesSource", "JsonlSource", "PadTruncate", "ParquetSource", "Source", "SpecialTokenFound", "SubstringMatcher", "TextSource", "Tokenizer", "Trained",
    "cached_file", "decode", "decode_udf", "detect_format", "encode", "encode_udf", "forbidden_counts", "from_json", "hub_token", "looks_like_repo_id",
    "pad_truncate", "patterns_found", "pretoken_counts", "pretokenize", "safe_ranges", "split_documents", "token_totals", "train_bpe", "train_superbpe", "wrap_truncate",
]
