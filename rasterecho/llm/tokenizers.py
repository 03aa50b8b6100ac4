"""Where the public tokenizer files lie; any other path may be given to the operators."""

from __future__ import annotations

import importlib


def word_tokenizer() -> str:
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")
