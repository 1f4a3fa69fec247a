"""Chunkers as table functions that SQL calls by LATERAL, named by the registry."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corvane.operators.chunking import CHUNKS, tokens
from corvane.plans.registry import Registry


def chunk_function(registry: Registry, name: str) -> Any:
    """The table function (text, options as JSON) of a chunker: a row per chunk, as `chunked` gives them; none for a null or empty text."""
    make = registry.create  # the registry goes to the workers by value, with the chunkers it names

    class Chunks:
        def __init__(self):
            self.options, self.chunker = None, None

        def eval(self, text: str, options: str) -> Iterator[tuple]:
            if self.chunker is None or options != self.options:
                self.options, self.chunker = options, make("chunker", name, **json.loads(options or "{}"))
            for k, (piece, start, end) in enumerate(self.chunker(text) if text else ()):
                yield k, piece, start, end, tokens(piece)

    return udtf(Chunks, returnType=CHUNKS)


def register_chunkers(spark: SparkSession, registry: Registry) -> list[str]:
    """Registers chunk_<name> for every chunker of the registry and returns these names. A call: SELECT d.id, c.* FROM d, LATERAL chunk_fixed(d.text, '{"length_tokens": 64}') c"""
    names = {f"chunk_{n}": n for n in registry.names("chunker") if n.isidentifier()}
    for function, name in names.items():
        spark.udtf.register(function, chunk_function(registry, name))
    return list(names)
