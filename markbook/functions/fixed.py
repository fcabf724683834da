"""Character sets, word lists and limits that decide the results.

They are data, not logic, and have to be exactly these for results to match.
"""

from __future__ import annotations

import functools
import string
import sys
import unicodedata

# --- fixed values: characters -------------------------------------------------------------
ASCII_PUNCT = string.punctuation
METRIC_PUNCT = "，。；：、（）【】《》！？“”‘’…—·"
ALIGN_PUNCT = METRIC_PUNCT + "『』〈〉〔〕％＋－＝＜＞＼／＠＆＊＃＄"
STEM_PUNCT = "，。；：、！？（）【】《》「」『』“”‘’…—·～．﹒＊＃＋－／＝"
FULLWIDTH_DIGITS = "０１２３４５６７８９"
NOTE_MARK_RANGES = (("①", "⑳"), ("⑴", "⑽"), ("㈠", "㈩"))
SPAN_EDGE_PUNCT = ",.;:!?()[]{}\"'，。；：！？（）「」『』“”‘’、·"
OPTION_LETTERS = "ABCDE"
OPTION_HINTS = ("选", "答案", "正确项", "正确选项", "项")
OPTION_VERBS_BEFORE = "选填答写应"
OPTION_NOUNS_AFTER = "项得"
OPTION_DELIMITERS = ",.;:!?()[]{}\"'，。；：！？、（）【】『』「」—·"

# --- fixed values: patterns ----------------------------------------------------------------
SENTENCE_BREAK_FINE = "[。！？；\\n，、]+"
SENTENCE_BREAK_COARSE = "[。！？；\\n]+"
OPTION_QUERY = (
    "(选\\s*[A-E]|[A-E]项|答案\\s*[A-E]|[A-E]正确|正确项为\\s*[A-E]|"
    "正确选项\\s*[A-E]|不正确项为\\s*[A-E]|[A-E]得|[A-E]为不正确)"
)
ANSI_COLOUR = "\\x1b\\[[0-9;]*m"
PHASE_ENTRY = 'phase="([a-zA-Z0-9._]+)" ms=([0-9.]+)'
CODE_FENCE = "(?m)^```(?:json)?\\s*|\\s*```$"

# --- fixed values: limits ------------------------------------------------------------------
MIN_STEM_MATCH = 8
MAX_SPAN_CHARS = 64
MAX_SPAN_TOKENS = 64
LOW_OCR_SCORE = 0.8
RATINGS = ("excellent", "good", "pass", "fail")
BUCKET_LABELS = ("0-20%", "20-40%", "40-60%", "60-80%", "80-100%")
HIT_TYPES = ("exact", "semantic", "miss")
HIT_STATUSES = ("hit_exact", "hit_semantic", "partial", "miss")


@functools.cache
def whitespace() -> str:
    """Every character Python (and Unicode) counts as whitespace."""
    return "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


@functools.cache
def note_marks() -> str:
    """Circled and bracketed numerals used as note marks."""
    return "".join(chr(c) for a, b in NOTE_MARK_RANGES for c in range(ord(a), ord(b) + 1))


def metric_drop() -> str:
    return whitespace() + ASCII_PUNCT + METRIC_PUNCT


def align_drop() -> str:
    return whitespace() + ASCII_PUNCT + ALIGN_PUNCT


def stem_drop(keep_digits: bool = False) -> str:
    digits = "" if keep_digits else string.digits
    return whitespace() + ASCII_PUNCT + digits + STEM_PUNCT + FULLWIDTH_DIGITS + note_marks()


@functools.cache
def fold_table() -> tuple[str, str]:
    """(from, to) for case and width folding: NFKC then lower case, one character to one.

    Characters whose folded form is longer than one character stay as they are. Those that are
    dropped before folding are left out.
    """
    dropped = set(align_drop())
    source, target = [], []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if char in dropped:
            continue
        wide = unicodedata.normalize("NFKC", char)
        folded = (wide if len(wide) == 1 else char).lower()
        if len(folded) == 1 and folded != char:
            source.append(char)
            target.append(folded)
    return "".join(source), "".join(target)
