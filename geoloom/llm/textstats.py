"""Counts of one text that the quality operators share; all are taken over the whole text."""

from __future__ import annotations

import numpy as np

from geoloom.llm.common import ids_of, n_repeat_words

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
LEADS = bytes(range(0xC0, 0x100))
DIGITS = b"0123456789"
#: Frequent words of the four languages of the corpus (fixed values).
STOP = frozenset(
    b"the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which"
    b" der die das und ist von den mit zu sich des ein eine nicht auf als auch im dem"
    b" de la le et les des en un une du est que dans qui pour par au il sur"
    b" el los las que y en del se por con para una su al lo como".split()
)
#: Names of the numbers that stats() gives, in order.
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_bang", "n_stop", "n_distinct", "n_same_next", "n_bytes",
    "n_symbol_words", "n_upper_words", "n_loose_bars", "n_long_words", "n_ended",
)


def less(text: bytes, gone: bytes) -> int:
    return len(text) - len(text.translate(None, gone))


def stats(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ids = ids_of(words)
    upper = less(text, UPPER)
    symbols = less(text, SYMBOLS)
    return (
        n,
        len(text.translate(None, CONTINUATION + BLANKS)),
        symbols,
        len(lines) - len(set(lines)),
        n_repeat_words(ids),
        len(lines),
        upper,
        upper + less(text, LOWER + LEADS),
        less(text, DIGITS),
        text.count(b"!!"),
        sum(map(STOP.__contains__, words)),
        int((ids == np.arange(n)).sum()),
        int((ids[1:] == ids[:-1]).sum()),
        len(text),
        sum(w[-1] in SYMBOLS for w in words) if symbols else 0,
        sum(map(bytes.isupper, words)) if upper else 0,
        words.count(b"|"),
        sum(len(w) > 30 for w in words),
        sum(x.rstrip().endswith((b".", b"!", b"?", b":", b";", b'"')) for x in lines),
    )
