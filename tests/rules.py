"""Small obligations for tests."""

from govspark.schemas import OBLIGATIONS, RESOURCES


def obligation(ord, id=None, include=(), exclude=(), tags=None, project=None, **rules):
    row = {name: None for name in OBLIGATIONS.names}
    row.update(
        project_id=project,
        id=id or f"o{ord}",
        ord=ord,
        title=f"Title {ord}",
        description="",
        provenance={"source_id": f"S{ord}", "document_type": None, "section_reference": None, "document_uri": None},
        enforcement_level=1,
        target={"include_patterns": list(include), "exclude_patterns": list(exclude), "match_tags": tags or {}},
        is_active=True,
        **rules,
    )
    return tuple(row[name] for name in OBLIGATIONS.names)


def obligations(spark, *rows):
    return spark.createDataFrame(list(rows), OBLIGATIONS)


def resources(spark, *rows):
    """(urn, tags) pairs in one project."""
    full = [("p", urn, urn.split(":")[1], None, tags, 0, 0, True, None) for urn, tags in rows]
    return spark.createDataFrame(full, RESOURCES)


def retention(days, trigger=1):
    return {"duration_s": days * 86400, "trigger": trigger, "allow_legal_hold_override": False}


def geo(allowed=(), denied=()):
    return {"allowed_regions": list(allowed), "denied_regions": list(denied), "strict_residency": False}


def purpose(allowed=(), denied=()):
    return {"allowed_purposes": list(allowed), "denied_purposes": list(denied)}


def privacy(method, **parameters):
    return {"method": method, "parameters": parameters}


def ai(training=True, tuning=True, rag=True, credit=""):
    return {
        "training_allowed": training, "fine_tuning_allowed": tuning, "rag_usage_allowed": rag,
        "requires_open_source_release": False, "attribution_text_required": credit,
    }
