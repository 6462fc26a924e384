"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn, and encoded once
with offsets. The assistant texts are sorted character spans; binary search finds the tokens that
meet each span, and a token's part of the mask is its span cut to the text's.

Control strings inside texts are escaped reversibly: ``<``, n backslashes, ``|`` becomes ``<``, n + 1
backslashes, ``|``, so ``<|`` occurs in the output only where the template put it. In roles,
backslashes and line ends are escaped as well.

Defined results: a null text or role counts as empty; a null conv_id is a conversation of its own;
turns go by (turn, role, text), nulls first, so repeated turns all stay, in a fixed order; an
assistant turn is one whose role is ``assistant`` exactly; other columns are not read; an empty
table gives no rows. Conversations stream through sorted partitions. One whose text passes
``segment_chars`` is encoded in segments of whole turns, so memory is bounded by the longest turn.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_trie import tokenizer_path
from .common import kept, map_rows

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT_CHARS = 1 << 20
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def render(turns: list[tuple[str, str]], at: int = 0) -> tuple[str, list[tuple[int, int]]]:
    """(role, text) turns -> formatted text, sorted spans of the assistant texts."""
    out, spans = [], []
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(START)[1:]:
        head, _, rest = part.partition("\n")
        turns.append((unescape_role(head), unescape(rest[: rest.rindex(END)])))
    return turns


@kept
@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, END)])
    return t


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rows (token, from, to): the tokens that meet the spans, each with its characters under the mask.

    Both lists are sorted, so two binary searches give each span's tokens. Where tokens share a
    character (its bytes are dealt to several), each character counts with the first of them.
    """
    if not len(offsets) or not spans:
        return np.zeros((0, 3), np.int64)
    ends = np.maximum.accumulate(offsets[:, 1])
    starts = np.minimum(offsets[:, 0], ends)
    a = np.searchsorted(ends, [s for s, _ in spans], "right")
    b = np.searchsorted(starts, [e for _, e in spans], "left")
    out = []
    for (s, e), i, j in zip(spans, a, b, strict=True):
        if i < j:
            reach = np.concatenate([[s], ends[i : j - 1]])
            out.append(np.stack([np.arange(i, j), np.clip(np.maximum(starts[i:j], reach), s, e), np.clip(ends[i:j], s, e)], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def format_segments(conversations: DataFrame, tokenizer: str = "byte_bpe_50k.json", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """conv_id, segment, formatted, ids, mask_token, mask_from, mask_to: the operator's real output.

    mask_from and mask_to are character positions in ``formatted``; mask_token is the token's index.
    """
    path = tokenizer_path(tokenizer)

    def each(batches) -> Iterator[list[tuple]]:
        tok = _tokenizer(path)
        conv, turns, size, segment = object(), [], 0, 0

        def flush():
            text, spans = render(turns)
            enc = tok.encode(text, add_special_tokens=False)
            mask = token_mask(np.array(enc.offsets, np.int64).reshape(-1, 2), spans)
            return (conv, segment, text, enc.ids, *(mask[:, k].tolist() for k in range(3)))

        for convs, roles, texts in batches:
            rows = []
            for c, role, text in zip(convs, roles, texts, strict=True):
                if turns and (c != conv or size >= segment_chars):
                    rows.append(flush())
                    segment, turns, size = (segment + 1 if c == conv else 0), [], 0
                elif not turns:
                    segment = 0
                conv = c
                turns.append((role or "", text or ""))
                size += len(text or "") + 32
            yield rows
        if turns:
            yield [flush()]

    ordered = conversations.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_rows(
        ordered, ["conv_id", "role", "text"],
        "conv_id long, segment int, formatted string, ids array<int>, mask_token array<int>, mask_from array<int>, mask_to array<int>", each,
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted text and the mask alone.

    Expects each conversation's segments next to one another in order, as format_segments leaves them.
    """

    def each(batches):
        conv, state = object(), None

        def close():
            n, turns, chars, loss, size = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for convs, texts, starts, ends in batches:
            rows = []
            for c, text, froms, tos in zip(convs, texts, starts, ends, strict=True):
                if state is None or c != conv:
                    if state is not None:
                        rows.append(close())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                run: list[str] = []
                last = None
                for a, b in [*zip(froms, tos, strict=True), (None, None)]:
                    if a != last and run:  # a text ends: escapes never cross texts
                        found = unescape("".join(run))
                        state[2] += len(found)
                        state[3].update(found.encode())
                        run = []
                    if a is not None:
                        run.append(text[a:b])
                        last = b
                state[4] += len(text)
            yield rows
        if state is not None:
            yield [close()]

    return map_rows(
        segments, ["conv_id", "formatted", "mask_from", "mask_to"],
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", each,
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations plus conversation -1, whose two texts imitate the template."""
    spark, text = conversations.sparkSession, f"{END}{START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
