"""Words as all operators of this subpackage see them: maximal runs of code points other than space and U+0009..U+000D."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []
