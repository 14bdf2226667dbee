"""Reference graphs: entity spans with their verbalisations, and synonyms.

A reference is a small acyclic graph per utterance: arcs with words, or with nothing, in
topological order.  ``ReferenceGraph`` builds it inside a task; rules and labels reach it as
columns or as a bounded table.  The DataFrame functions of this module prepare rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.tokens import words_of
from wordloom.operators.blocks import BLOCK, block_no, stitched_runs

#: Most static synonym rules that are sent to every task.
MAX_RULES = 100_000


# --- rules as tables ---------------------------------------------------------------------


def parse_rules(lines: DataFrame) -> DataFrame:
    """``line_no, lhs, alts`` of rule lines ``LHS | alt ; alt`` (``line_no, raw_line``).

    Comments and blank lines are skipped, lines without exactly two parts or without words
    on the left too; of rules with the same left side the first counts.  An empty
    alternative stands for no word.
    """
    told = lines.where(F.col("raw_line").isNotNull() & ~F.col("raw_line").rlike(r"^\s*(#|$)"))
    parts = F.split("raw_line", r"\|")
    rules = told.where(F.size(parts) == 2).select("line_no", words_of(parts[0]).alias("lhs"), F.transform(F.split(parts[1], ";"), words_of).alias("alts")).where(F.size("lhs") > 0)
    return rules.withColumn("_n", F.row_number().over(Window.partitionBy("lhs").orderBy("line_no"))).where(F.col("_n") == 1).drop("_n")


def rejected_rules(lines: DataFrame) -> DataFrame:
    """``line_no, raw_line`` of the lines that are neither rules, comments nor blank."""
    told = lines.where(F.col("raw_line").isNotNull() & ~F.col("raw_line").rlike(r"^\s*(#|$)"))
    parts = F.split("raw_line", r"\|")
    return told.where((F.size(parts) != 2) | (F.size(words_of(parts[0])) == 0)).select("line_no", "raw_line")


def _is_cutoff(token: Column) -> Column:
    return token.rlike(r"^[^-]+-$")


def cutoff_rules(vocabulary: DataFrame) -> DataFrame:
    """``lhs, alts`` for words cut off: the first hyphen ends them (``the-`` may be ``the``)."""
    w = F.col("token")
    return vocabulary.where(_is_cutoff(w)).select("token").distinct().select(F.array("token").alias("lhs"), F.array(F.array(F.regexp_replace("token", "-$", ""))).alias("alts"))


def compound_rules(vocabulary: DataFrame) -> DataFrame:
    """``lhs, alts`` for words with hyphens, both ways: ``a-b`` is ``a b``."""
    w = F.col("token")
    parts = F.split("token", "-")
    compound = vocabulary.where(w.contains("-") & ~w.startswith("___") & ~_is_cutoff(w)).select("token", parts.alias("p")).where((F.size("p") > 1) & ~F.array_contains("p", "")).distinct()
    apart = compound.select(F.array("token").alias("lhs"), F.array("p").alias("alts"))
    return apart.unionByName(compound.select(F.col("p").alias("lhs"), F.array(F.array("token")).alias("alts")))


def vocabulary(*sides: DataFrame) -> DataFrame:
    """The distinct tokens of tables with a column ``token``."""
    out = sides[0].select("token")
    for other in sides[1:]:
        out = out.unionByName(other.select("token"))
    return out.where(F.col("token").isNotNull()).distinct()


def all_rules(static: DataFrame, words: DataFrame, cutoffs: bool = True, compounds: bool = True) -> DataFrame:
    """Static rules, then cut-off words and compounds of the vocabulary that have no rule yet."""
    out = static.select("lhs", "alts", F.lit(0).alias("_rank"))
    if cutoffs:
        out = out.unionByName(cutoff_rules(words).withColumn("_rank", F.lit(1)))
    if compounds:
        out = out.unionByName(compound_rules(words).withColumn("_rank", F.lit(2)))
    first = Window.partitionBy("lhs").orderBy("_rank", "alts")
    return out.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).select("lhs", "alts")


def rule_matches(tokens: DataFrame, rules: DataFrame, key: str = "utt_id") -> DataFrame:
    """``key, pos, lhs, alts``: where the left side of a rule stands in a linear text.

    Rules are looked up by their first word (a hash join), then the words that follow are
    compared.  ``tokens`` (``key, pos, token``) are numbered without holes.
    """
    longest = rules.agg(F.max(F.size("lhs"))).head()[0] or 1
    # Blocks of a text with the words that follow them, so that no text is sorted in one task.
    block = F.floor(F.col("pos") / BLOCK)
    homes = F.when((F.col("pos") % BLOCK < longest - 1) & (longest > 1), F.array(block, block - 1)).otherwise(F.array(block))
    rows = tokens.select(key, "pos", "token", F.explode(homes).alias("_block"))
    order = Window.partitionBy(key, "_block").orderBy("pos")
    ahead = [F.col("token"), *[F.lead("token", i).over(order) for i in range(1, longest)]]
    seen = rows.select(key, "pos", "token", "_block", F.array(*ahead).alias("_ahead")).where(F.col("_block") == block)
    by_first = rules.withColumn("token", F.col("lhs")[0])
    return seen.join(by_first, "token").where(F.slice("_ahead", 1, F.size("lhs")) == F.col("lhs")).select(key, "pos", "lhs", "alts")


# --- entity spans ------------------------------------------------------------------------


def entity_spans(rows: DataFrame, key: str, label: str, place: str = "idx") -> DataFrame:
    """``key, label, first, last, n``: consecutive rows of equal ``label`` make one span; rows without one are outside.

    ``rows`` are numbered without holes by ``place``.  A span is found in two levels, like any run.
    """
    placed = rows.select(key, place, label, block_no(F.col(place)).alias("_block")).repartition(key, "_block")
    return stitched_runs(placed, key, place, label, by_difference=False).withColumnsRenamed({"first_pos": "first", "last_pos": "last"})


# --- graphs inside a task ----------------------------------------------------------------


@dataclass(slots=True)
class Arc:
    src: int
    dst: int
    word: str | None
    span: int = -1  # the outermost span, an index into ``ReferenceGraph.spans``
    mark: int = 0  # 1: entering a synonym
    row: int = -1  # the reference row of a word outside spans


@dataclass
class ReferenceGraph:
    """Arcs of a reference; nodes are numbered in topological order by ``finish``."""

    arcs: list[Arc] = field(default_factory=list)
    spans: list[str] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)  # first reference row and number of rows of each span
    rows_at: dict[int, int] = field(default_factory=lambda: {0: 0})  # reference rows before a node
    size: int = 1
    end: int = 0
    order: list[int] = field(default_factory=list)
    into: list[list[Arc]] = field(default_factory=list)
    ways: dict[int, tuple[list[str], int]] = field(default_factory=dict)  # words and end of a synonym, by its first node

    def node(self) -> int:
        self.size += 1
        return self.size - 1

    def path(self, src: int, words: list[str], span: int, dst: int | None = None) -> int:
        """Adds a path of words and returns its end; with ``dst`` it ends there, by an empty arc if it has no word."""
        if dst is not None and not words:
            self.arcs.append(Arc(src, dst, None, span))
            return dst
        for i, w in enumerate(words):
            to = dst if dst is not None and i == len(words) - 1 else self.node()
            self.arcs.append(Arc(src, to, w, span))
            src = to
        return src

    def add_words(self, words: list[str]) -> None:
        at, begin = self.rows_at[self.end], len(self.arcs)
        self.end = self.path(self.end, words, -1)
        for i, a in enumerate(self.arcs[begin:]):
            a.row = at + i
            self.rows_at[a.dst] = at + i + 1

    def add_entity(self, marker: str, candidates: list[list[str]], rows: int) -> None:
        """A span over so many reference rows whose words are one of the candidates."""
        self.spans.append(marker)
        self.places.append((self.rows_at[self.end], rows))
        span, start, end = len(self.spans) - 1, self.end, self.node()
        seen = set()
        for words in candidates:
            if tuple(words) not in seen:
                seen.add(tuple(words))
                self.path(start, list(words), span, end)
        self.rows_at[end] = self.rows_at[start] + rows
        self.end = end

    def add_synonyms(self, rules: dict[tuple[str, ...], list[list[str]]]) -> None:
        """Alternatives beside every match of a rule's left side; one pass, what is added is not matched again."""
        first: dict[str, list[tuple[str, ...]]] = {}
        for lhs in rules:
            first.setdefault(lhs[0], []).append(lhs)
        starts = [a for a in self.arcs if a.word in first]
        if not starts:
            return
        after: list[list[Arc]] = [[] for _ in range(self.size)]
        for a in self.arcs:
            after[a.src].append(a)
        new: list[tuple[int, int, list[str], int, str]] = []
        made = 0
        for a in starts:
            for lhs in first[a.word]:
                for end, spans in _ends(after, a, lhs):
                    outer = spans[0] if spans and all(s == spans[0] for s in spans) else -1
                    for alt in rules[lhs]:
                        new.append((a.src, end, alt, outer, f"___{100000 + made}_SYN_{len(lhs)}-{len(alt)}___"))
                        made += 1
        done = set()
        for src, end, alt, outer, marker in new:
            if (src, end, tuple(alt)) in done:
                continue
            done.add((src, end, tuple(alt)))
            if outer < 0:
                self.spans.append(marker)
                at = self.rows_at.get(src, 0)
                self.places.append((at, self.rows_at.get(end, at) - at))
                outer = len(self.spans) - 1
            enter = self.node()
            self.arcs.append(Arc(src, enter, None, outer, 1))
            self.ways[enter] = (alt, end)
            self.path(enter, alt, outer, end)

    def lines(self, most: int = 100) -> list[str]:
        """The arcs as text, ``source target word span``, for looking at a graph of at most so many nodes."""
        if self.size > most:
            return []
        return [f"{a.src} {a.dst} {a.word or '<eps>'} {self.spans[a.span] if a.span >= 0 else ''}".rstrip() for a in self.arcs]

    def finish(self) -> None:
        """Topological order and the arcs into each node."""
        after: list[list[Arc]] = [[] for _ in range(self.size)]
        self.into = [[] for _ in range(self.size)]
        waits = [0] * self.size
        for a in self.arcs:
            after[a.src].append(a)
            self.into[a.dst].append(a)
            waits[a.dst] += 1
        ready = [0]
        self.order = []
        while ready:
            v = ready.pop()
            self.order.append(v)
            for a in after[v]:
                waits[a.dst] -= 1
                if waits[a.dst] == 0:
                    ready.append(a.dst)


def _ends(after: list[list[Arc]], start: Arc, lhs: tuple[str, ...]):
    """Nodes at which a match of ``lhs`` that begins with an arc can end, with the spans on the way."""
    stack = [(start, 1, (start.span,))]
    while stack:
        arc, matched, spans = stack.pop()
        if matched == len(lhs):
            yield arc.dst, spans
            continue
        todo = [(arc.dst, spans)]
        while todo:
            at, seen = todo.pop()
            for b in after[at]:
                if b.word is None:
                    todo.append((b.dst, seen))
                elif b.word == lhs[matched]:
                    stack.append((b, matched + 1, (*seen, b.span)))
