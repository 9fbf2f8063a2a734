"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, divergence, jaccard_join, language_id, lm_score, media_avi, mixing, packing, pii, quality, secret_scan, vector_dedup, warc_history


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_read(spark, sf_dir, "documents"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(_read(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_read(spark, sf_dir, "documents"))


def op8_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.digest(media_avi.store(_read(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, _read(spark, sf_dir, "labels")))


def op10_warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_history.histories(_read(spark, sf_dir, "pages")).drop("url_key")  # its rules are beyond SQL; the order follows it


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_read(spark, sf_dir, "documents"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_secret_scan, op3_pii, op4_mixing, op5_vector_dedup, op6_packing, op7_jaccard_join, op8_media_avi, op9_quality, op10_warc_history, op11_collocations, op12_lm_score, op13_divergence_audit, pipeline)
    return {f.__name__: f for f in own}


_COMPONENTS = """reach(node, other) as (select a, b from sym union select r.node, s.b from reach r join sym s on r.other = s.a)"""


def _secret_sql() -> str:
    """The rules' spans in SQL: starts are the lengths of what stands before, between and within matches."""

    def spans(k: int, r: secret_scan.Rule) -> str:
        # Only runs long enough are looked for where that is the same: a run of one class can't begin inside another.
        pattern = (r.pattern.removesuffix("+") + f"{{{r.least},}}" if r.kind == "hex" else r.pattern).replace("'", "''")
        found = f"select doc_id, regexp_extract_all(t, '{pattern}', 0) as h, regexp_extract_all(t, '{pattern}', {r.group}) as g, string_split_regex(t, '{pattern}') as p from d where regexp_matches(t, '{pattern}')"
        at = "list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)"
        return f"select doc_id, {k} as place, '{r.kind}' as kind, {at} as a, {at} + length(h[i]) as b from (select *, unnest(range(1, len(h) + 1)) as i from ({found})) where length(g[i]) >= {r.least}"

    base = sum(r.base for r in secret_scan.RULES)
    said = "kind || ':' || a::bigint || ':' || b::bigint, ',' order by a, place, b"
    counts = ", ".join(f"count(*) filter (place = {k}) as n_{r.kind}" for k, r in enumerate(secret_scan.RULES) if r.base)
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), s as ({" union all ".join(spans(k, r) for k, r in enumerate(secret_scan.RULES))})
    select doc_id, {counts}, sha256(coalesce(string_agg({said}) filter (place < {base}), '')) as base_sha256, coalesce(string_agg({said}) filter (place is not null), '') as spans from d left join s using (doc_id) group by doc_id"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _collocation_sql() -> str:
    """Counts of all phrases, then each cut's score; words are kept as arrays, so that parts of a phrase are slices."""
    return f"""with d as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
    w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from d),
    g as (select lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase, k from w, (select unnest([1, 2, 3]) as k) where len(w) >= k),
    f as (select lang, k, phrase, count(*) as f from g group by all), n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
    c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
    cut as (select c.*, j, array_to_string(w[:j], ' ') as x, array_to_string(w[j + 1:], ' ') as y from c, (select unnest([1, 2]) as j) where j < k),
    s as (select cut.*, x.f as l, y.f as r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) as score from cut join f x on x.lang = cut.lang and x.phrase = cut.x join f y on y.lang = cut.lang and y.phrase = cut.y),
    b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
    o as (select lang, phrase, max(a) as longer from (select lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) as phrase from c where k = 3) group by 1, 2)
    select lang, rank, phrase, a, l, r, n, score::bigint as score from (select b.*, n, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
    from b join n on n.lang = b.lang left join o on o.lang = b.lang and o.phrase = b.phrase where longer is null or 100 * longer < 50 * a) where rank <= 2000"""


def _divergence_sql() -> str:
    """The contract's sums in 128-bit integers; pairs of sources meet at every kept term of their language."""
    return f"""with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
    t as (select i, lang, source, unnest(w) as term from d), k as (select lang, term, count(*)::hugeint as c from t group by 1, 2 having count(distinct i) >= 3),
    g as (select distinct lang, source from d), c as (select lang, source, term, count(*)::hugeint as c from t join k using (lang, term) group by 1, 2, 3),
    v as (select lang, count(*)::hugeint as v, sum(c)::hugeint as n from k group by 1), m as (select lang, source, sum(c)::hugeint as n from c group by 1, 2),
    p as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(m.n, 0) + v.v) as p from g join k on k.lang = g.lang join v on v.lang = g.lang left join m on m.lang = g.lang and m.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    q as (select k.lang, term, 1 + (1000000000 * (k.c + 1)) // (n + v) as q from k join v using (lang)),
    f as (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // y.p)::bigint as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3),
    r as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(value, 0) as value from g x join g y on x.lang = y.lang and x.source <> y.source left join f on f.lang = x.lang and f.source = x.source and f.item = y.source
    union all select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from p join q using (lang, term) where c > 0 and p > q)
    select lang, source, part, item, value, rank::int as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r) where part = 'pair' or rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can say over whole tables; the other queries are tested against brute force in tests/llm."""
    return {
        "op2_secret_scan": _secret_sql(),
        "op5_vector_dedup": f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where label is not null and embedding is not null),
        u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from v), p as (select x.vec_id as a, y.vec_id as b from u x join u y on x.label = y.label and x.vec_id < y.vec_id where list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.93),
        sym as (select a, b from p union all select b, a from p), {_COMPONENTS}, n as (select a, count(*) as n_links from sym group by 1), c as (select node, least(node, min(other)) as component_id from reach group by 1)
        select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept from embeddings left join n on a = vec_id left join c on node = vec_id""",
        "op7_jaccard_join": f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
        n as (select doc_id, count(*) as n from s group by 1), k as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
        p as (select a, b from k join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)), sym as (select a, b from p union all select b, a from p), {_COMPONENTS}, c as (select node, least(node, min(other)) as component_id from reach group by 1)
        select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id left join c on node = d.doc_id""",
        "op11_collocations": _collocation_sql(),
        "op13_divergence_audit": _divergence_sql(),
        "op10_warc_history": """with d as (select page_id, coalesce(html, '') as h from pages), f as (select h, min(page_id) as first from d group by 1), x as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(h) as hx, first from d join f using (h))
        select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hx, (i // 4 * 5 + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))::bigint) & 31) + 1, 1)), '') as payload_digest,
        case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, 1704067200 + page_id as capture_ts from x""",
    }
