"""A query and the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# --- SQL forms of the table views ---------------------------------------------------------------
QUESTION = "doc_id % (select count(*) from benchmark)"
ANSWERS = f"""answers as (
  select doc_id as answer_id, {QUESTION} as question_id, lang as subject, source as class_name,
         text as answer_text from documents)"""
POINTS = """words as (select item_id, string_split(lower(text), ' ') as w, len(w) as n from benchmark),
points as (
  select item_id as question_id, p as point_id, w[(p - 1) * n // 4 + 1] as point_text,
         w[(p - 1) * n // 4 + 2 : p * n // 4] as aliases, p::double as weight
  from words, unnest([1, 2, 3, 4]::bigint[]) t(p))"""
LINES = """lines as (
  select l_orderkey, l_linenumber, sum(l_quantity) as qty, max(l_partkey) as pk, max(l_suppkey) as sk,
         min(l_returnflag) as rf, min(l_linestatus) as ls
  from lineitem group by 1, 2)"""
VOTES = f"""{LINES},
votes as (
  select l_orderkey as sample_id, l_linenumber as point_id, r as round, (pk + r * sk) % 3 > 0 as hit,
         ['miss', 'exact', 'semantic'][(pk + r * sk) % 3 + 1] as hit_type,
         'r' || r || 'q' || qty::int as extracted_span,
         (qty + 7 * r) % 50 / 50 as confidence,
         case when (pk + r * sk) % 3 = 2 then 0.5 end::double as partial_credit,
         qty::int as span_length, 60 as answer_length
  from lines, unnest([0, 1, 2]) t(r))"""
LABELS = f"""{VOTES},
labels0 as (select v.*, o_orderpriority as origin from votes v join orders on o_orderkey = sample_id where round = 0)"""
DETAILS = f"""{LINES},
details as (
  select l_orderkey as answer_id, o_custkey % 50 as question_id, o_orderpriority as class_name,
         l_linenumber::bigint as point_id, qty as weight,
         case when rf = 'R' then 'hit_exact' when rf = 'A' then 'hit_semantic' when ls = 'O' then 'miss'
              else 'partial' end as hit_status,
         qty * case when rf in ('R', 'A') then 1 when ls = 'O' then 0 else 0.25 end as point_score
  from lines join orders on o_orderkey = l_orderkey)"""
RATING = """case when max_score <= 0 then 'fail' when total_score / max_score >= 0.9 then 'excellent'
  when total_score / max_score >= 0.75 then 'good' when total_score / max_score >= 0.6 then 'pass' else 'fail' end"""
RESULTS = f"""{DETAILS},
sums as (
  select answer_id, question_id, class_name, sum(point_score)::double as total_score, sum(weight)::double as max_score
  from details group by 1, 2, 3),
results as (select *, {RATING} as rating from sums)"""
