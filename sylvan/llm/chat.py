"""Chat formatting: a finite-state machine over roles and a declarative template.

Every turn becomes text segments, each with a loss flag. Control strings of the template
inside a text are broken by an escape character, so that only the template can mark turns
and the formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import table

#: Marks of each role as (before, after, whether its text is under the loss); "*" stands for any
#: other role, whose name is written as well. start and next give the valid turn orders.
TEMPLATE = {
    "roles": {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
        "user": ("<s>[INST] ", " [/INST]\n", False),
        "assistant": ("<<OUT>>\n", "</s>\n", True),
        "*": ("<<ROLE>>", "<</ROLE>>\n", False),
    },
    "name_end": "<</NAME>>",
    "controls": ["<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "<<OUT>>", "<<ROLE>>", "<</ROLE>>", "<</NAME>>"],
    "escape": "\\",
    "start": ["system", "user"],
    "next": {"system": ["user"], "user": ["assistant"], "assistant": ["user"]},
}


class Template:
    """A compiled template."""

    def __init__(self, spec: dict = TEMPLATE):
        self.spec, self.mark = spec, spec["escape"]
        longest_first = sorted(spec["controls"], key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, [self.mark, *longest_first])))
        self.escaped = re.compile(re.escape(self.mark) + "(" + re.escape(self.mark) + ")?")

    def escape(self, text: str) -> str:
        """Doubles the escape character and puts one behind the first character of each control string."""
        return self.special.sub(lambda m: self.mark * 2 if m[0] == self.mark else m[0][0] + self.mark + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[1] or "", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's segments with loss flags: mark, text, mark."""
        known = role in self.spec["roles"] and role != "*"
        before, after, loss = self.spec["roles"][role if known else "*"]
        if not known:
            before += self.escape(role) + self.spec["name_end"]
        return [(before, False), (self.escape(text), loss), (after, False)]

    def allowed(self, previous: str | None, role: str) -> bool:
        """Whether role may follow previous (None: at the start)."""
        return role in (self.spec["start"] if previous is None else self.spec["next"].get(previous, ()))

    def read(self, turn: str) -> tuple[str, str]:
        """(role, text) of one formatted turn."""
        for role, (before, after, _) in self.spec["roles"].items():
            if turn.startswith(before) and turn.endswith(after):
                body = turn[len(before) : len(turn) - len(after)]
                if role == "*":
                    name, _, body = body.partition(self.spec["name_end"])
                    role = self.unescape(name)
                return role, self.unescape(body)
        raise ValueError("not a formatted turn")


SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, valid boolean"


def format_chat(conversations: DataFrame, spec: dict = TEMPLATE) -> DataFrame:
    """Segments of conversations(conv_id, turn, role, text), in order within each conversation.

    Columns: conv_id, turn_no (from 0), segment (from 0 in a turn), text, loss, valid (the
    turns so far follow the template's order). Turns are taken by turn, then role, then
    text; repeated rows are turns of their own. Null text and null role are empty, a null
    conv_id is a conversation. Invalid conversations are formatted too and carry valid =
    false. Rows stream through sorted partitions, so no conversation is held in memory; one
    turn is, whole, however long. Other columns are ignored, whatever their names; an empty
    table gives no segments.
    """
    import pandas as pd

    def run(batches):
        template = Template(spec)
        at = previous = None
        number, valid, begun = 0, True, False
        for pdf in batches:
            out = []
            for conv, role, text in zip(pdf.conv_id, pdf.role, pdf.text):
                conv = None if pd.isna(conv) else int(conv)
                if not begun or conv != at:
                    at, previous, number, valid, begun = conv, None, 0, True, True
                valid = valid and template.allowed(previous, role)
                out += [(conv, number, i, s, loss, valid) for i, (s, loss) in enumerate(template.segments(role, text))]
                previous, number = role, number + 1
            yield pd.DataFrame(out, columns=["conv_id", "turn_no", "segment", "text", "loss", "valid"]).astype({"conv_id": "Int64"})

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInPandas(run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, spec: dict = TEMPLATE) -> DataFrame:
    """One row for each conversation, from format_chat's output alone: DIGEST.

    Turns are parsed from the formatted text by the template's marks; digests are fed turn
    by turn. Expects the segments as format_chat leaves them: a conversation's segments
    together and in order.
    """
    import pandas as pd

    def run(batches):
        template = Template(spec)
        state, turn, out = None, [], []

        def end_turn():
            if turn:
                role, text = template.read("".join(turn))
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["n"] += 1
                turn.clear()

        def end():
            if state is not None:
                end_turn()
                out.append((state["id"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["valid"]))

        def frame():
            pdf = pd.DataFrame(out, columns=[f.split()[0] for f in DIGEST.split(", ")]).astype({"conv_id": "Int64"})
            out.clear()
            return pdf

        for pdf in batches:
            for conv, number, part, text, loss, valid in zip(pdf.conv_id, pdf.turn_no, pdf.segment, pdf.text, pdf.loss, pdf.valid):
                conv = None if pd.isna(conv) else int(conv)
                if part == 0:
                    if number == 0:
                        end()
                        state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "valid": True}
                    else:
                        end_turn()
                turn.append(text)
                state["chars"] += len(text)
                state["valid"] = state["valid"] and bool(valid)
                if loss:
                    plain = template.unescape(text)
                    state["loss_chars"] += len(plain)
                    state["loss"].update(plain.encode())
            yield frame()
        end()
        yield frame()

    return segments.mapInPandas(run, DIGEST)


#: A conversation whose texts hold the template's own control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all conversations and PROBE, formatted and read back."""
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_chat(rows))


def _sql() -> str:
    controls = "|".join(re.escape(c) for c in sorted(TEMPLATE["controls"], key=len, reverse=True))
    sizes = {r: len(b) + len(a) for r, (b, a, _) in TEMPLATE["roles"].items()}
    known = ", ".join(f"'{r}'" for r in sizes if r != "*")
    marks = " ".join(f"WHEN '{r}' THEN {n}" for r, n in sizes.items() if r != "*")
    extra = lambda c: f"len(regexp_extract_all({c}, '\\\\|{controls}'))"
    nexts = " OR ".join(f"(prev = '{a}' AND role = '{b}')" for a, bs in TEMPLATE["next"].items() for b in bs)
    starts = ", ".join(f"'{r}'" for r in TEMPLATE["start"])
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), o AS (
  SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, length(text) + {extra('text')} + CASE role {marks} ELSE {sizes['*'] + len(TEMPLATE['name_end'])} + length(role) + {extra('role')} END AS chars,
         CASE WHEN k = 1 THEN role IN ({starts}) ELSE {nexts} END AS ok FROM o
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, bool_and(ok) AS valid
FROM s GROUP BY conv_id
"""


SQL = _sql()
