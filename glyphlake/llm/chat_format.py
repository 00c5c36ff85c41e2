"""Chat formatting by incremental black-box rendering.

A template is any callable that turns a list of (role, text) into one string. Nothing is
known about it: the prefixes of a conversation are rendered one turn longer at a time and
consecutive outputs are compared. What the longer output adds is the turn's span; an
output that does not begin with the one before shows a template that rewrites history.
Inside a span, the text is found by rendering the same prefix with a one-character probe in
its place that the output doesn't hold: the two first differ where the text begins, and what
follows the probe is what follows the text.

Every prefix is rendered from the first turn on, whatever a conversation's length: what a
template does to a turn far back shows only there. That is two renderings a turn (the prefix, and
the prefix with a probe as its last text), so work grows with the square of a conversation's
turns; README has figures. Outputs are compared with the one before only, so memory stays at
three renderings.

Nulls: null texts and roles are empty; a null conv_id is a conversation of its own. Rows
with the same turn are ordered by role, then text. Empty texts have an empty span.
Very long texts are rendered whole. An empty table gives an empty result. Conversations are
streamed in order, one at a time, each by one task; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Of these control and private characters one that an output lacks is its probe; the first ones don't make strings wider.
PROBES = [chr(c) for c in (*range(1, 9), *range(14, 32), *range(0xE000, 0xF900))]

#: The control strings of the template below all hold one of the first three characters, and a role ends at the fourth.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("\n", "~3"))


def escape(s: str, role: bool = False) -> str:
    for plain, coded in ESCAPES[: 4 if role else 3]:
        s = s.replace(plain, coded)
    return s


def unescape(s: str) -> str:
    for plain, coded in reversed(ESCAPES):
        s = s.replace(coded, plain)
    return s


class Memo:
    """Rendered turns by (role, text), emptied beyond ``most`` characters."""

    def __init__(self, most: int = 16_000_000):
        self.most, self.chars, self.known = most, 0, {}

    def __call__(self, turn: Turn) -> str:
        out = self.known.get(turn)
        if out is None:
            role, text = turn
            out = f"<s>[INST] {escape(role, True)}\n{escape(text)}</s>\n"
            if self.chars > self.most:
                self.known, self.chars = {}, 0
            self.known[turn] = out
            self.chars += 2 * len(out) + 200
        return out


_turn = Memo()


def turn_template(turns: list[Turn]) -> str:
    """``<s>[INST] role`` newline ``text</s>`` newline for each turn, control strings in texts escaped."""
    return "".join(map(_turn, turns))


def parse_turns(formatted: str) -> list[Turn]:
    """The turns of what ``turn_template`` wrote, unescaped."""
    out = []
    for part in formatted.split("<s>[INST] ")[1:]:
        role, _, text = part.removesuffix("</s>\n").partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


def common_prefix(a: str, b: str, known: str = "") -> int:
    """How many characters both begin with; if both begin with ``known``, only what follows is looked at."""
    low, high = 0, min(len(a), len(b))
    if known and a.startswith(known) and b.startswith(known):
        low = len(known)
        return low + common_prefix(a[low:], b[low:])
    if b.startswith(a[:high]):
        return high
    while high - low > 1:  # a[:low] is shared, a[:high] is not
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def locate(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """The rendering; for each turn the span it added and the span of its text; the first turn whose output rewrote the one before."""
    spans: list[tuple[int, int, int, int]] = []
    previous, rewritten = "", None
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        kept = common_prefix(previous, now)
        if kept < len(previous) and rewritten is None:
            rewritten = k
        probe = next(p for p in PROBES if p not in now)
        probed = template([*turns[:k], (role, probe)])
        head = common_prefix(now, probed, previous)
        tail = len(probed) - head - 1
        spans.append((kept, len(now), head, max(head, len(now) - tail)))
        previous = now
    return previous, spans, rewritten


FORMATTED = (
    "conv_id long, n_turns long, formatted string, rewrites_history boolean, rewritten_at int,"
    " turns array<struct<role: string, start: long, end: long, text_start: long, text_end: long>>"
)


def format_conversations(turns: DataFrame, template: Template = turn_template) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text): its rendering and its turns' spans, in code points.

    rewritten_at is the number of the first turn (from 0) whose rendering changed what was there before it, null if none did.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: object = None
        held: list[Turn] = []

        def close() -> dict:
            text, spans, rewritten = locate(template, held)
            rows = [{"role": r, "start": s, "end": e, "text_start": ts, "text_end": te} for (r, _), (s, e, ts, te) in zip(held, spans, strict=True)]
            return {"conv_id": key, "n_turns": len(held), "formatted": text, "rewrites_history": rewritten is not None, "rewritten_at": rewritten, "turns": rows}

        def table(rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame(rows).astype({"conv_id": "Int64", "rewritten_at": "Int32"})

        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None), batch["role"], batch["text"], strict=True):
                if held and conv != key:
                    out.append(close())
                    held = []
                key = conv
                held.append((role, text))
            if out:
                yield table(out)
        if held:
            yield table([close()])

    clean = turns.select(F.col("conv_id").cast("long"), F.col("turn"), store.text_or_empty("role").alias("role"), store.text_or_empty().alias("text"))
    n = store.parallelism(turns.sparkSession)
    return clean.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of what the formatted strings hold, and of the text under the mask of the assistant's turns."""
    for batch in batches:
        out = []
        for conv, formatted, spans, rewrites in zip(batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None), batch["formatted"], batch["turns"], batch["rewrites_history"], strict=True):
            turns = parse_turns(formatted)
            said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
            loss = "".join(unescape(formatted[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == "assistant")
            out.append((conv, len(turns), said.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), rewrites))
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]).astype({"conv_id": "Int64"})


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, pos AS turn, role, '{said}' AS text FROM (SELECT posexplode(array('user', 'assistant')) AS (pos, role))")
    rows = store.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra)
    return format_conversations(rows).mapInPandas(read_back, DIGESTS).drop("rewrites_history")


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + 2 * length(role) - length(regexp_replace(role, '[~<\[\n]', '', 'g'))
    + 2 * length(text) - length(regexp_replace(text, '[~<\[]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
