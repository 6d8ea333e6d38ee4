"""Tools over the code graph of a data folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.operators import extract, graph, quality
from codeweft.operators.schema import legal_pairs
from codeweft.plans import catalog_tools, tool_sql, tools
from codeweft.session import cut
from codeweft.sources.code_graph import CodeGraph
from codeweft.sources.tables import table


def _graph(spark, d):
    return CodeGraph(lambda name: table(spark, d, name))


#: Labels and relations of the structure, and relations of the framework that these tables have cases of.
STRUCTURE = ("Folder", "File", "Method", "Route", "BladeTemplate", "DatabaseTable", "DatabaseColumn", "EloquentModel", "ConfigKey", "EnvVariable", *tools.KINDS)
RELATIONS = ("CONTAINS", "DEFINES", "IMPORTS", "CALLS", "DISPATCHES", "USES_TYPE", "ROUTES_TO", "USES_TABLE", "QUERIES_TABLE", "HAS_COLUMN", "EXTENDS_TEMPLATE", "INCLUDES_TEMPLATE", "USES_CONFIG", "USES_ENV", "EXTENDS_CLASS", "IMPLEMENTS_INTERFACE", "USES_TRAIT")
OF_FRAMEWORK = ("INJECTS", "VALIDATES_WITH", "TRANSFORMS_WITH", "HAS_PERFORMANCE_RISK", "BELONGS_TO_FEATURE", "HAS_RELATIONSHIP", "BINDS_TO", "HAS_COMPONENT", "RENDERS_TEMPLATE", "REFERENCES_TABLE", "APPLIES_MIDDLEWARE", "LISTENS_TO", "CALLS_EXTERNAL", "TESTS")


def graph_status(spark, d):
    g = _graph(spark, d)
    return tools.status(g.nodes(*STRUCTURE), g.edges(*RELATIONS))


def graph_framework(spark, d):
    g = _graph(spark, d)
    return g.edges(*OF_FRAMEWORK).groupBy("rel", "detail").agg(F.count(F.lit(1)).alias("n"))


def graph_violations(spark, d):
    g = _graph(spark, d)
    return graph.undeclared_pairs(g.edges(), g.nodes(), legal_pairs(spark))


def tool_context(spark, d):
    g = _graph(spark, d)
    rels = ("DEFINES", "EXTENDS_CLASS", "IMPLEMENTS_INTERFACE", "USES_TRAIT", "CALLS", "DISPATCHES", "USES_TYPE")
    return tools.context(g.nodes("File", "Method", *tools.KINDS), g.edges(*rels), g.nodes(*tools.KINDS))


def tool_impact(spark, d):
    g = _graph(spark, d)
    # written once, as both are read twice and their plans are large
    nodes = cut(g.nodes("Method", "Route", "DatabaseTable", *tools.KINDS).select("node_id", "label", "name"), "nodes")
    edges = cut(g.edges(*dict.fromkeys(tools.USERS + tools.REACH)).select("src", "rel", "dst").distinct(), "edges")
    return tools.impact(nodes, edges, nodes)


def tool_request_flow(spark, d):
    g = _graph(spark, d)
    return tools.request_flow(g.nodes("Method", "DatabaseTable", "Class_"), g.edges("ROUTES_TO", "CALLS", "DISPATCHES", "QUERIES_TABLE"), g.nodes("Route"))


def tool_flows(spark, d):
    g = _graph(spark, d)
    return tools.flows(g.nodes("Method"), g.edges("CALLS", "ROUTES_TO"))


def tool_dead_methods(spark, d):
    g = _graph(spark, d)
    return tools.dead_methods(g.nodes("Method", *tools.KINDS), g.edges("CALLS", "ROUTES_TO", "DISPATCHES", "DEFINES", "EXTENDS_CLASS"), g.method_sources(), g.routes().select("action"))


def tool_cross_cutting(spark, d):
    g = _graph(spark, d)
    return tools.cross_cutting(g.nodes("Method"), g.edges("CALLS"))


def tool_table_access(spark, d):
    g = _graph(spark, d)
    return tools.table_access(g.nodes("DatabaseTable"), g.edges("QUERIES_TABLE"))


def tool_write_impact(spark, d):
    g = _graph(spark, d)
    return tools.write_impact(g.nodes("Class_"), g.edges("QUERIES_TABLE", "DISPATCHES"), g.nodes("DatabaseTable"))


def tool_settings(spark, d):
    g = _graph(spark, d)
    return tools.setting_usage(g.nodes("ConfigKey", "EnvVariable"), g.edges("USES_CONFIG", "USES_ENV"))


def tool_features(spark, d):
    g = _graph(spark, d)
    return tools.features(g.routes().select("node_id", "uri").distinct(), g.nodes("Class_").select("node_id", "name"))


def tool_changed_symbols(spark, d):
    g = _graph(spark, d)
    late = table(spark, d, "source_files").filter("loaded_at > committed_at + interval 1 day").select(F.col("path").alias("file_path"), F.lit("late").alias("change")).distinct()
    return tools.changed_symbols(g.nodes("Method", *tools.KINDS), late)


def tool_unused_classes(spark, d):
    g = _graph(spark, d)
    return tools.symbols_without_use(g.nodes(*tools.KINDS), g.edges("EXTENDS_CLASS", "IMPLEMENTS_INTERFACE", "USES_TRAIT", "DISPATCHES", "USES_TYPE"))


def call_graph(spark, d):
    return _graph(spark, d).calls().groupBy("call_type", "target_kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


def call_targets(spark, d):
    return _graph(spark, d).calls().select("src", "target", "line").distinct()


def query_risks(spark, d):
    return extract.query_risks(_graph(spark, d).method_sources())


def race_conditions(spark, d):
    return quality.race_conditions(_graph(spark, d).method_sources()).select("method", "pattern", "columns")


def tool_routes(spark, d):
    return catalog_tools.route_list(_graph(spark, d)).select("node_id", "repo", "http_method", "uri", "controller", "action", "handler")


def tool_api_surface(spark, d):
    return catalog_tools.api_surface(_graph(spark, d))


def tool_models(spark, d):
    return catalog_tools.model_list(_graph(spark, d))


def tool_events(spark, d):
    return catalog_tools.event_list(_graph(spark, d))


def tool_bindings(spark, d):
    return catalog_tools.binding_list(_graph(spark, d))


def tool_schema(spark, d):
    return catalog_tools.schema_list(_graph(spark, d))


def tool_db_context(spark, d):
    return catalog_tools.table_context(_graph(spark, d))


def tool_resolve_column(spark, d):
    return catalog_tools.column_context(_graph(spark, d))


def tool_connection_map(spark, d):
    return catalog_tools.connection_map(_graph(spark, d))


def tool_explain(spark, d):
    return catalog_tools.explained(_graph(spark, d))


def tool_list_repos(spark, d):
    return catalog_tools.repo_list(_graph(spark, d))


def tool_map(spark, d):
    return catalog_tools.layer_map(_graph(spark, d))


def tool_risks(spark, d):
    return catalog_tools.risk_list(_graph(spark, d))


def tool_outbound_apis(spark, d):
    return catalog_tools.outbound_calls(_graph(spark, d))


def tool_tests(spark, d):
    return catalog_tools.test_map(_graph(spark, d))


def tool_feature_context(spark, d):
    return catalog_tools.feature_context(tool_features(spark, d))


def tool_security_surface(spark, d):
    return catalog_tools.security_surface(_graph(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        graph_status, graph_framework, graph_violations, call_graph, call_targets, query_risks, race_conditions, tool_context, tool_impact, tool_request_flow, tool_flows, tool_dead_methods, tool_cross_cutting, tool_table_access, tool_write_impact, tool_settings,
        tool_features, tool_changed_symbols, tool_unused_classes, tool_routes, tool_api_surface, tool_models, tool_events, tool_bindings, tool_schema, tool_db_context, tool_resolve_column, tool_connection_map, tool_explain, tool_list_repos, tool_map,
        tool_risks, tool_outbound_apis, tool_tests, tool_feature_context, tool_security_surface,
    )
}
SQL = tool_sql.SQL
