"""The declared labels and relations of a code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: All labels.
LABELS = (
    "Folder File Namespace Class_ Trait_ Interface_ Enum_ Method Function_ Property Constant EloquentModel Controller Middleware ServiceProvider Job Event Listener Policy FormRequest Resource Notification Observer Command "
    "Factory Seeder Route BladeTemplate BladeComponent LivewireComponent Migration DatabaseConnection DatabaseTable DatabaseColumn InferredRelationship StoredProcedure DatabaseView UsageContext ServiceBinding ConfigKey EnvVariable "
    "ScheduledTask Community Process Feature Contract TestCase PerformanceRisk HttpClientCall Gate"
).split()
#: All relations.
RELATIONS = (
    "CONTAINS DEFINES EXTENDS_CLASS IMPLEMENTS_INTERFACE USES_TRAIT IMPORTS CALLS USES_TYPE ROUTES_TO APPLIES_MIDDLEWARE HAS_RELATIONSHIP BINDS_TO DISPATCHES LISTENS_TO HANDLES NOTIFIES BLADE_CALLS RENDERS_TEMPLATE "
    "INCLUDES_TEMPLATE EXTENDS_TEMPLATE HAS_COMPONENT MIGRATES_TABLE HAS_COLUMN REFERENCES_TABLE HAS_TABLE HAS_PROCEDURE HAS_VIEW USES_TABLE QUERIES_TABLE PROCEDURE_READS PROCEDURE_WRITES INFERRED_REFERENCES HAS_USAGE_CONTEXT "
    "CONTEXT_READS CONTEXT_WRITES USES_CONFIG USES_ENV INJECTS AUTHORIZES_WITH VALIDATES_WITH TRANSFORMS_WITH SCHEDULES MEMBER_OF STEP_IN_PROCESS COUPLED_WITH OBSERVES AUTHORIZES_MODEL DEFINES_FACTORY BELONGS_TO_FEATURE GOVERNS "
    "TESTS HAS_PERFORMANCE_RISK CALLS_EXTERNAL DEFINES_GATE CHECKS_GATE"
).split()

_KINDS = ("Class_", "Trait_", "Interface_", "Enum_")
#: The pairs of labels between which the build writes edges.
PAIRS = (
    [("CONTAINS", "Folder", "Folder"), ("CONTAINS", "Folder", "File"), ("CALLS", "Method", "Method"), ("ROUTES_TO", "Route", "Method"), ("DEFINES", "File", "Route"), ("IMPORTS", "File", "File"), ("EXTENDS_TEMPLATE", "BladeTemplate", "BladeTemplate"), ("INCLUDES_TEMPLATE", "BladeTemplate", "BladeTemplate")]
    + [("HAS_COLUMN", "DatabaseTable", "DatabaseColumn"), ("USES_TABLE", "EloquentModel", "DatabaseTable"), ("QUERIES_TABLE", "Method", "DatabaseTable"), ("USES_CONFIG", "File", "ConfigKey"), ("USES_ENV", "File", "EnvVariable"), ("DEFINES", "File", "BladeTemplate")]
    + [("RENDERS_TEMPLATE", "Method", "BladeTemplate"), ("HAS_COMPONENT", "BladeTemplate", "BladeTemplate"), ("HAS_RELATIONSHIP", "EloquentModel", "EloquentModel"), ("REFERENCES_TABLE", "DatabaseColumn", "DatabaseTable"), ("APPLIES_MIDDLEWARE", "Route", "Middleware")]
    + [("HAS_PERFORMANCE_RISK", "Method", "PerformanceRisk"), ("CALLS_EXTERNAL", "Method", "HttpClientCall"), ("BELONGS_TO_FEATURE", "Route", "Feature"), ("BELONGS_TO_FEATURE", "Class_", "Feature"), ("TESTS", "TestCase", "Route"), ("TESTS", "TestCase", "Class_")]
    + [("VALIDATES_WITH", "Method", "Class_"), ("TRANSFORMS_WITH", "Method", "Class_")]
    + [(r, a, b) for r in ("INJECTS", "BINDS_TO", "LISTENS_TO") for a in _KINDS for b in _KINDS]
    + [(r, a, b) for r in ("EXTENDS_CLASS", "IMPLEMENTS_INTERFACE", "USES_TRAIT") for a in _KINDS for b in _KINDS]
    + [x for k in _KINDS for x in (("DEFINES", "File", k), ("DEFINES", k, "Method"), ("DISPATCHES", "Method", k), ("USES_TYPE", "Method", k), ("CALLS", "Method", k))]
)


def legal_pairs(spark: SparkSession) -> DataFrame:
    """(rel, src_label, dst_label)."""
    return spark.createDataFrame(PAIRS, "rel string, src_label string, dst_label string")
