"""Queries over training data and the SQL of those that SQL can express."""

from __future__ import annotations

from codeweft.llm import documentation, generated, leaks, prose, ranking, splitting, syntax, tokens
from codeweft.sources.tables import table, tables


def p2_found(spark, d):
    return splitting.long_methods(*tables(spark, d, "methods", "source_files")).select("method_id")


def p2_pieces(spark, d):
    return splitting.method_pieces(*tables(spark, d, "methods", "source_files"))


def p4_found(spark, d):
    return documentation.prose_methods(*tables(spark, d, "parsed_classes", "source_files"))


def p4_pairs(spark, d):
    return documentation.documented_methods(*tables(spark, d, "parsed_classes", "source_files"))


def p5_found(spark, d):
    return syntax.broken_files(table(spark, d, "source_files"))


def p5_rates(spark, d):
    return syntax.error_rates(table(spark, d, "source_files"))


def p6_found(spark, d):
    return generated.tool_files(table(spark, d, "source_files"))


def p6_origins(spark, d):
    return generated.file_origins(table(spark, d, "source_files"))


def p7_found(spark, d):
    return ranking.heads(table(spark, d, "search_results"))


def p7_ranking(spark, d):
    return ranking.ranking(table(spark, d, "search_results"))


def p8_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def p9_found(spark, d):
    docs, items = tables(spark, d, "documents", "eval_items")
    return leaks.leaks(docs, leaks.item_texts(items)).select("doc_id", "item_id")


def p9_items(spark, d):
    return leaks.leaked_items(*tables(spark, d, "documents", "eval_items"))


def p10_found(spark, d):
    return prose.not_prose(*tables(spark, d, "documents", "common_words"))


def p10_statistics(spark, d):
    return prose.document_statistics(*tables(spark, d, "documents", "common_words"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_pieces, p4_found, p4_pairs, p5_found, p5_rates, p6_found, p6_origins, p7_found, p7_ranking, p8_ids, p9_found, p9_items, p10_found, p10_statistics)
}

_PRESENT = "case when isnan({0}) or {0} = 0 then null else {0} end"
SQL = {
    "p7_found": f"""
      with hit as (select query_id, node_id, max({_PRESENT.format('bm25_score')}) as b, max({_PRESENT.format('vector_score')}) as v, max({_PRESENT.format('fuzzy_score')}) as f
                   from search_results where query_id is not null and node_id is not null group by 1, 2)
      select query_id, node_id from hit h where b is not null and v is not null and f is not null
        and (select count(*) from hit o where o.query_id = h.query_id and o.b > h.b) <= 1 and (select count(*) from hit o where o.query_id = h.query_id and o.v > h.v) <= 1 and (select count(*) from hit o where o.query_id = h.query_id and o.f > h.f) <= 1""",
}
