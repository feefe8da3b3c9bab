"""The piece vocabulary of a SentencePiece model, and the split of texts into pre-tokens that no piece crosses."""

from __future__ import annotations

import re
from functools import cache

SPACE = "▁"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")
DEFAULT_MODEL = "piece_bpe_32k.model"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


class Vocabulary:
    """Pieces by text, their scores, and the ids of byte pieces. Pieces must not hold a space mark after another character,
    so that a text may be split before each run of spaces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.text: list[str] = [model.id_to_piece(i) for i in range(self.size)]
        self.score: list[float] = [model.get_score(i) for i in range(self.size)]
        self.byte_of: dict[int, int] = {}
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.byte_of[i] = int(piece[1:-1], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
        crossing = [p for p in self.ids if re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing:
            raise ValueError(f"pieces cross words: {crossing[:3]}")
        self.longest = max(map(len, self.ids))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text without the space mark that each begins with; an empty text has none."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    if SPACE * 2 not in marked:
        return marked.split(SPACE)[1:]
    return [x[1:] for x in _RUNS.findall(marked)]
