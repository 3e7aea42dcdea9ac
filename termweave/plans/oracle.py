"""DuckDB SQL building blocks for the oracle queries.

Each public query of ``termweave.plans.queries`` has an equivalent SQL text
built from these pieces.  The regexes are the same strings the Spark side
uses (RE2 and Java agree on them: no ``\\s``/``\\w`` shorthands are used).
"""

from __future__ import annotations

from termweave.functions import text as T
from termweave.sources.stopwords import spark_default


# Fixed values of the rules, stated here again so that the SQL does not follow the package:
# the tags whose content is dropped, the shape of a URL with a scheme and a host, and the
# text of a failed fetch.
DROPPED_TAGS = ("nav", "header", "footer", "script", "style", "noscript", "iframe")
WITH_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
HOST_PART = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"
UNREAD = "Failed to fetch URL"


def stop_list() -> str:
    return T.sql_string_list(spark_default("french"))


def clean_sql(col: str = "text") -> str:
    t = f"lower(coalesce({col}, ''))"
    t = f"regexp_replace({t}, '{T.URL_PATTERN}', '', 'g')"
    t = f"regexp_replace({t}, '{T.EMAIL_PATTERN}', '', 'g')"
    t = f"regexp_replace({t}, '{T.non_word_pattern()}', ' ', 'g')"
    return f"trim({t})"


def tokens_sql(col: str = "text", stop: bool = True, min_length: int = 2) -> str:
    cond = f"length(x) >= {max(min_length, 1)}"
    if stop:
        cond += f" and not list_contains({stop_list()}, x)"
    return f"list_filter(string_split({clean_sql(col)}, ' '), lambda x: {cond})"


def ngrams_sql(tok: str, n: int) -> str:
    if n == 1:
        return tok
    return (f"case when len({tok}) >= {n} then list_transform(range(1, len({tok}) - {n - 2}), "
            f"lambda i: array_to_string(list_slice({tok}, i, i + {n - 1}), ' ')) else [] end")


def words_sql(col: str, min_chars: int) -> str:
    pat = T.WORD_A if min_chars <= 1 else T.WORD_B
    return f"regexp_extract_all(lower(coalesce({col}, '')), '{pat}', 0)"


# documents as sets: set_id = source, role by smallest doc_id, ord = rank
DOCS_CTE = """docs as (
  select source as set_id, doc_id, text,
         cast(row_number() over (partition by source order by doc_id) - 1 as integer) as ord,
         case when row_number() over (partition by source order by doc_id) = 1
              then 'target' else 'competitor' end as role
  from documents)"""


def tokens_cte(stop: bool = True) -> str:
    return f"""toks as (
  select set_id, doc_id, role, ord, {tokens_sql('text', stop)} as tokens from docs)"""


def terms_cte(ns=(1, 2, 3)) -> str:
    parts = []
    for n in ns:
        g = ngrams_sql("tokens", n)
        parts.append(f"""select set_id, doc_id, role, ord, {n} as n,
         unnest(g) as term, cast(generate_subscripts(g, 1) - 1 as integer) as pos
  from (select set_id, doc_id, role, ord, {g} as g from toks)""")
    return "terms as (\n  " + "\n  union all\n  ".join(parts) + ")"


TF_CTE = """tf as (
  select set_id, doc_id, role, ord, n, term, count(*) as frequency,
         cast(min(pos) as integer) as first_pos
  from terms group by set_id, doc_id, role, ord, n, term)"""


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def nonblank_sql(col: str = "text") -> str:
    return f"({col} is not null and regexp_matches({col}, '[^{T.WS}]'))"


def tfidf_ctes(min_chars: int = 1, ngram=(1, 1), max_features: int | None = 200) -> list[str]:
    """CTEs nb, ndocs, rw, rtf, vocab, wt, sc(set_id, doc_id, role, term, frequency,
    weight, tfidf_score)."""
    lo, hi = ngram
    grams = " || ".join(ngrams_sql("w", n) for n in range(max(lo, 1), hi + 1))
    cut = f"where rank <= {max_features}" if max_features else ""
    return [
        f"nb as (select * from docs where {nonblank_sql('text')})",
        "ndocs as (select set_id, count(*) as n_docs from nb group by set_id)",
        f"""rw as (select set_id, doc_id, role, unnest(g) as term from (
  select set_id, doc_id, role, {grams} as g from (
    select set_id, doc_id, role, {words_sql('text', min_chars)} as w from nb)))""",
        "rtf as (select set_id, doc_id, role, term, count(*) as tf from rw group by set_id, doc_id, role, term)",
        f"""vocab as (select * from (
  select set_id, term, total, df, cast(row_number() over (partition by set_id order by total desc, term)
         as integer) as rank
  from (select set_id, term, cast(sum(tf) as bigint) as total, count(*) as df from rtf
        group by set_id, term)) {cut})""",
        """wt as (select rtf.set_id, rtf.doc_id, rtf.role, rtf.term, rtf.tf as frequency,
  rtf.tf * (ln((1.0 + ndocs.n_docs) / (1.0 + vocab.df)) + 1.0) as weight
  from rtf join vocab on rtf.set_id = vocab.set_id and rtf.term = vocab.term
  join ndocs on rtf.set_id = ndocs.set_id)""",
        """sc as (select *, weight / sqrt(sum(weight * weight) over (partition by set_id, doc_id))
  as tfidf_score from wt)""",
    ]


STATS_CTE = """stats as (
  select set_id, n, term,
         cast(coalesce(sum(frequency) filter (where role = 'competitor'), 0) as bigint) as frequency,
         bool_or(role = 'target') as in_target,
         bool_or(role = 'competitor') as in_comp,
         min(doc_id) filter (where role = 'competitor') as first_doc,
         arg_min(first_pos, doc_id) filter (where role = 'competitor') as first_pos
  from tf group by set_id, n, term)"""


def gap_sql(k: int | None) -> str:
    cut = f"where rank <= {k}" if k else ""
    return ("select set_id, n, term, frequency, rank from (select set_id, n, term, frequency, "
            "cast(row_number() over (partition by set_id, n order by frequency desc, first_doc, "
            f"first_pos) as integer) as rank from stats where in_comp and not in_target) {cut}")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{T.WS}]+|[{T.WS}]+$', '', 'g')"


def decode_sql(x: str) -> str:
    for ent, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def pages_cte() -> str:
    """Page sets: set_id = lower-cased network location, ord by page_id."""
    h = "html"
    for tag in DROPPED_TAGS:
        h = f"regexp_replace({h}, '(?s)<{tag}\\b.*?</{tag}>', '', 'g')"
    return f"""pg as (
  select page_id, url, html, {h} as kept,
         lower(regexp_extract(url, '{HOST_PART}', 1)) as set_id,
         coalesce(regexp_matches(url, '{WITH_HOST}'), false) as valid,
         case when not coalesce(regexp_matches(url, '{WITH_HOST}'), false) or html is null
              then '{UNREAD}' end as error,
         cast(row_number() over (partition by lower(regexp_extract(url, '{HOST_PART}', 1))
              order by page_id) - 1 as integer) as ord
  from pages)"""


def page_text_ctes() -> list[str]:
    """CTEs ``pg`` and ``pt(page_id, url, set_id, ord, error, title, h1, body_text,
    all_text)``: the text of the given pages, written from the rules.

    Excluded blocks go first; the rest is cut into comments, tags and texts in
    order.  A ``p`` without an end tag stays open, so its extent ends at the first
    later place where fewer ``p`` are open, or at the end of the article.  The
    given pages have no list item, ``h2`` to ``h6``, image or description."""
    text = strip_sql(decode_sql("t"))
    title = strip_sql(decode_sql("regexp_extract(kept, '(?s)<title[^>]*>(.*?)</title>', 1)"))
    h1 = strip_sql(decode_sql("regexp_extract(kept, '(?s)<h1[^>]*>(.*?)</h1>', 1)"))
    return [
        pages_cte(),
        "sq as (select page_id, regexp_extract_all(kept, '(?s)<!--.*?-->|<[^>]*>|[^<]+') as l from pg)",
        "tk as materialized (select page_id, unnest(l) as t, generate_subscripts(l, 1) as i from sq)",
        """dp as materialized (select page_id, t, i, sum(case when t = '<p>' then 1 when t = '</p>' then -1 else 0 end)
  over (partition by page_id order by i) as open,
  min(case when t in ('</article>', '</body>') then i end) over (partition by page_id) as stop,
  max(i) over (partition by page_id) + 1 as past from tk)""",
        """ps as (select a.page_id, a.i, coalesce(min(b.i), min(least(coalesce(a.stop, a.past), a.past))) as e
  from dp a left join dp b on a.page_id = b.page_id and b.i > a.i and b.open < a.open
  where a.t = '<p>' group by a.page_id, a.i)""",
        f"""px as (select ps.page_id, ps.i, string_agg({text}, '' order by tk.i) as x
  from ps join tk on ps.page_id = tk.page_id and tk.i > ps.i and tk.i < ps.e and tk.t not like '<%'
  group by ps.page_id, ps.i)""",
        """bd as materialized (select ps.page_id, string_agg(coalesce(x, ''), ' ' order by ps.i) as body_text
  from ps left join px on ps.page_id = px.page_id and ps.i = px.i group by ps.page_id)""",
        f"""pt as materialized (select *, concat_ws(' ', nullif(title, ''), nullif(h1, ''), nullif(body_text, '')) as all_text
  from (select pg.page_id, url, set_id, ord, error, {title} as title, {h1} as h1,
               coalesce(body_text, '') as body_text from pg left join bd on pg.page_id = bd.page_id))""",
    ]


# single pages as documents: the set is the URL
PAGE_DOCS_CTE = """docs as materialized (select url as set_id, page_id as doc_id, 0 as ord, 'target' as role, all_text as text
  from pt where error is null and all_text <> '')"""

# pages of comparable hosts as documents: the number of the entry is the id
HOST_DOCS_CTE = """docs as materialized (select set_id, cast(ord as bigint) as doc_id, ord, url, all_text as text,
  case when ord = 0 then 'target' else 'competitor' end as role from pt
  where (ord = 0 or error is null) and set_id in (
    select set_id from pt where error is null group by set_id having count(distinct url) >= 2))"""
