"""Where the vocabulary files of public tokenizers are; the folder is a parameter of the operators."""

from __future__ import annotations

import os


def vocabulary(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
