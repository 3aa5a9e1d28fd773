"""Chat formatting over typed content parts, in DataFrame functions only.

A message holds an ordered list of parts: text, image, audio, document or any other kind. A visitor
flattens each part: text is escaped, every other kind becomes a placeholder that names it, with the
attachment's reference and the number of tokens it expands to recorded beside. A template marks the
turns; control strings that stand in a text are escaped, so the formatted conversation reads back to
exactly the turns that went in. The loss mask lists the spans, in UTF-8 bytes, that hold what the
chosen roles said.

Messages are flattened and escaped before the shuffle. A conversation is one string, so its turns meet
in one task; its window sorts and sums turns with spilling, and only the string itself is held whole.

Defined cases: a null list of parts, null part or null text is empty; a null role is the empty role; a
null conversation id is one conversation of its own, a null turn comes first; messages of equal turn go
by role, then by content, and repeated rows all stay; a size that an attachment lacks counts as 0, at least one token each; an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"


@dataclass(frozen=True)
class Template:
    """Control strings. None may be the start of another, hold a backslash, be shorter than two characters
    or end as it begins, so that none can come about where texts and marks meet."""

    turn: str = "[INST]"
    content: str = "[/INST]"
    end: str = "</s>"
    attachment: str = "[ATT]"
    attachment_end: str = "[/ATT]"

    def __post_init__(self):
        c = self.controls
        bad = any(len(x) < 2 or "\\" in x or any(x[:i] == x[-i:] for i in range(1, len(x))) for x in c)
        if bad or any(a != b and a in b for a in c for b in c) or len(set(c)) < len(c):
            raise ValueError("control strings must be distinct, free of one another and of backslashes, and not end as they begin")

    @property
    def controls(self) -> list[str]:
        return [self.turn, self.content, self.end, self.attachment, self.attachment_end]

    def escape(self, c: Column) -> Column:
        """A backslash goes before every backslash and after the first character of every control string."""
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(s[0] + "\\" + s[1:])), self.controls, c)

    @staticmethod
    def unescape(c: Column) -> Column:
        return F.regexp_replace(c, r"(?s)\\(.)", "$1")


@dataclass(frozen=True)
class PartVisitor:
    """What becomes of a part of each kind: ``visit`` gives a struct of the piece of text, and of the attachment's kind,
    reference and expanded token count (null for text)."""

    template: Template = Template()
    #: Pixels along the side of an image patch, tokens per second of audio and per page of a document.
    patch: int = 28
    per_second: float = 25.0
    per_page: int = 1024

    def text(self, part: Column) -> tuple[Column, Column]:
        return self.template.escape(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("long")

    def image(self, part: Column) -> tuple[Column, Column]:
        across, down = (F.ceil(F.greatest(F.coalesce(part[x], F.lit(0)), F.lit(0)) / self.patch) for x in ("width", "height"))
        return self.placeholder(part), (across * down).cast("long")

    def audio(self, part: Column) -> tuple[Column, Column]:
        return self.placeholder(part), F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * self.per_second).cast("long")

    def document(self, part: Column) -> tuple[Column, Column]:
        return self.placeholder(part), (F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * self.per_page).cast("long")

    def other(self, part: Column) -> tuple[Column, Column]:
        return self.placeholder(part), F.lit(1).cast("long")

    def placeholder(self, part: Column) -> Column:
        t = self.template
        return F.concat(F.lit(t.attachment), t.escape(F.coalesce(part["kind"], F.lit(""))), F.lit(t.attachment_end))

    def visit(self, part: Column) -> Column:
        kinds: dict[str, Callable] = {"text": self.text, "image": self.image, "audio": self.audio, "document": self.document}
        kind = F.when(part.isNull(), F.lit("text")).otherwise(F.coalesce(part["kind"], F.lit("")))

        def choose(i: int) -> Column:
            chain = reduce(lambda c, k: c.when(kind == k, kinds[k](part)[i]), kinds, F)
            return chain.otherwise(self.other(part)[i])
        return F.struct(choose(0).alias("piece"), kind.alias("kind"), part["ref"].alias("ref"),
                        F.when(kind != "text", F.greatest(choose(1), F.lit(1))).alias("tokens"))


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    nothing = F.lit(None)
    return F.array(F.struct(F.lit("text"), text, nothing, nothing, nothing, nothing, nothing)).cast(f"array<{PART}>")


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                learn: tuple[str, ...] = ("assistant",), visitor: PartVisitor | None = None) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``loss_spans`` (start and length in UTF-8 bytes) and
    ``attachments`` (kind, reference, tokens; the n-th one belongs to the n-th placeholder)."""
    visitor = visitor or PartVisitor()
    t = visitor.template
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                           F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), visitor.visit).alias("visited"))
    rows = rows.select("conv", "turn", "role", F.concat(F.lit(t.turn), t.escape(F.col("role")), F.lit(t.content)).alias("head"),
                       F.array_join(F.transform("visited", lambda v: v["piece"]), "").alias("body"),
                       F.transform(F.filter("visited", lambda v: v["kind"] != "text"),
                                   lambda v: F.struct(v["kind"].alias("kind"), v["ref"].alias("ref"), v["tokens"].alias("tokens"))).alias("attached"))
    size = F.octet_length("head") + F.octet_length("body") + len(t.end.encode())
    earlier = (Window.partitionBy("conv").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "body")])
               .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("place", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    one = F.struct("place", F.concat("head", "body", F.lit(t.end)).alias("piece"), F.col("role").isin(*learn).alias("learnt"),
                   (F.col("place") + F.octet_length("head")).alias("start"), F.octet_length("body").cast("long").alias("length"), "attached")
    whole = placed.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("turns"))   # the turns of one conversation
    return whole.select(
        F.col("conv").alias(conv), F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["learnt"]),
                    lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda x: x["attached"])).alias("attachments"))


def read_back(formatted: DataFrame, conv: str = "conv_id", template: Template | None = None) -> DataFrame:
    """What the formatted conversations say: ``turns`` (role, text, kinds of the attachments in order) and
    ``learnt``, the unescaped text of each span of the loss mask."""
    t = template or Template()

    def literal(s: str) -> str:
        return "\\Q" + s + "\\E"
    placeholder = literal(t.attachment) + "(?s:(.*?))" + literal(t.attachment_end)

    def turn(x: Column) -> Column:
        halves = F.split(x, literal(t.content), 2)
        body = halves[1]
        return F.struct(t.unescape(F.substr(halves[0], F.lit(len(t.turn) + 1))).alias("role"),
                        t.unescape(F.regexp_replace(body, placeholder, "")).alias("text"),
                        F.transform(F.regexp_extract_all(body, F.lit(placeholder), F.lit(1)), t.unescape).alias("kinds"))
    ended = F.split("formatted", literal(t.end), -1)
    cut = formatted.select("*", F.col("formatted").cast("binary").alias("_bytes"))
    return cut.select(F.col(conv), "formatted", F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), turn).alias("turns"),
                      F.transform("loss_spans", lambda s: t.unescape(F.substr(
                          F.col("_bytes"), (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))).alias("learnt"),
                      "attachments")


def digests(back: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of what was read back."""
    learnt = F.array_join("learnt", "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(F.col(conv), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def digests_sql(conversations: str, template: Template | None = None) -> str:
    """``digests`` of a table of text messages as DuckDB SQL."""
    t = template or Template()

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def escaped(c: str) -> str:
        return reduce(lambda x, s: f"replace({x}, {q(s)}, {q(s[0] + chr(92) + s[1:])})", t.controls, f"replace({c}, {q(chr(92))}, {q(chr(92) * 2)})")
    marks = len(t.turn + t.content + t.end)
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({conversations}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({escaped('role')}) + length({escaped('text')}) + {marks}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
