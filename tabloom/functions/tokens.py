"""Marker strings of the sample text and the ids of the byte vocabulary."""

from __future__ import annotations

# Markers in sample text.
QA_SEP = "<|endinput|>"
END_COMPLETION = "<|endcompletion|>"
CHOICE_SEP = "||"
STRUCTURE = {
    "key": ("<|KEY|>", "<|/KEY|>"),
    "value": ("<|VALUE|>", "<|/VALUE|>"),
    "example": ("<|EXAMPLE|>", "<|/EXAMPLE|>"),
    "context": ("<|CONTEXT|>", "<|/CONTEXT|>"),
    "meta": ("<|META|>", "<|/META|>"),
    "prefix": ("<|PREFIX|>", "<|/PREFIX|>"),
    "quantile": ("<|QUANTILE|>", "<|/QUANTILE|>"),
    "scale": ("<|SCALE|>", "<|/SCALE|>"),
    "suffix": ("<|SUFFIX|>", "<|/SUFFIX|>"),
    "choices": ("<|CHOICES|>", "<|/CHOICES|>"),
}
# Fixed value: label positions that do not count towards the loss.
IGNORE = -100

# Ids 0-255 are bytes; the others follow.
BOS_ID = 256
PAD_ID = 257
FIRST_SPECIAL_ID = 258


def special_tokens(style: str) -> list[str]:
    """Markers a tokenizer must keep whole for a serializer style."""
    shared = [END_COMPLETION, QA_SEP]
    if style == "basic":
        return shared
    if style == "structured":
        parts = ("choices", "context", "key", "prefix", "suffix", "example", "value")
        return shared + [CHOICE_SEP] + [t for p in parts for t in STRUCTURE[p]]
    return shared + [CHOICE_SEP]
