"""Public tokenizers in Spark tasks: the driver reads the file, the workers get its bytes and no path."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

#: Where the public tokenizers' package lies, unless it can be imported anyway.
TOKENIZERS_DIR = "/opt/tokenizers"


def tokenizer_path(name: str, folder: str = TOKENIZERS_DIR) -> str:
    """The place of a tokenizer's file on the driver: `name` if it is a file, else that file of the public tokenizers."""
    if Path(name).is_file():
        return name
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return str(Path(folder) / name)


_MADE: dict[str, object] = {}


class Tokenizers:
    """What `make` makes of a tokenizer's file, once a worker, kept from task to task. The file is broadcast: a few MB."""

    def __init__(self, spark: SparkSession, path: str, make: Callable[[bytes], object]):
        data = Path(path).read_bytes()
        self.key = f"{make.__name__}-{hashlib.sha256(data).hexdigest()}"
        self.file, self.make = spark.sparkContext.broadcast(data), make

    def get(self) -> object:
        if self.key not in _MADE:
            _MADE[self.key] = self.make(self.file.value)
        return _MADE[self.key]
