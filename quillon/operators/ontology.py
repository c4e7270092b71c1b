"""Ontologies: the schema of a graph as dimension tables, aliases, validation, prompts, versions, alignment."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.errors import ConfigurationError, SerializationError


@dataclass(frozen=True)
class Property:
    name: str
    data_type: str = "string"
    required: bool = False
    pattern: str | None = None
    allowed_values: tuple[str, ...] = ()


@dataclass(frozen=True)
class EntityType:
    name: str
    description: str | None = None
    aliases: tuple[str, ...] = ()
    properties: tuple[Property, ...] = ()
    patterns: tuple[tuple[str, str | None], ...] = ()


@dataclass(frozen=True)
class RelationType:
    name: str
    description: str | None = None
    sources: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    properties: tuple[Property, ...] = ()


_TYPES = "pos int, name string, description string, aliases array<string>, patterns array<struct<pattern:string,description:string>>"
_RELATIONS = "pos int, name string, description string, sources array<string>, targets array<string>"
_PROPERTIES = "kind string, owner string, pos int, name string, data_type string, required boolean, pattern string, allowed array<string>"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Ontology:
    """Types in order. As tables: entity_types, relation_types, properties; all are small and of a size that the schema sets, not the data."""

    name: str
    version: str = "1"
    entities: tuple[EntityType, ...] = ()
    relations: tuple[RelationType, ...] = ()
    description: str | None = None

    def to_json(self) -> str:
        from dataclasses import asdict

        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Ontology:
        try:
            d = json.loads(text)
            props = lambda x: tuple(Property(p["name"], p.get("data_type", "string"), p.get("required", False), p.get("pattern"), tuple(p.get("allowed_values", ()))) for p in x.get("properties", ()))
            es = tuple(EntityType(e["name"], e.get("description"), tuple(e.get("aliases", ())), props(e), tuple((p[0], p[1]) for p in e.get("patterns", ()))) for e in d.get("entities", ()))
            rs = tuple(RelationType(r["name"], r.get("description"), tuple(r.get("sources", ())), tuple(r.get("targets", ())), props(r)) for r in d.get("relations", ()))
            return Ontology(d["name"], d.get("version", "1"), es, rs, d.get("description"))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise SerializationError(f"not an ontology: {e}") from e

    def entity_types(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, e.name, e.description, list(e.aliases), list(e.patterns)) for i, e in enumerate(self.entities)], _TYPES)

    def relation_types(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, r.name, r.description, list(r.sources), list(r.targets)) for i, r in enumerate(self.relations)], _RELATIONS)

    def properties(self, spark: SparkSession) -> DataFrame:
        rows = [(k, t.name, i, p.name, p.data_type, p.required, p.pattern, list(p.allowed_values)) for k, ts in (("entity", self.entities), ("relation", self.relations)) for t in ts for i, p in enumerate(t.properties)]
        return spark.createDataFrame(rows, _PROPERTIES)

    def names(self, spark: SparkSession) -> DataFrame:
        """(label, canonical): every alias and name, in lower case; an alias goes before a name, an earlier type before a later one."""
        t = self.entity_types(spark)
        every = t.select(F.lit(0).alias("rank"), "pos", F.explode("aliases").alias("label"), "name").unionByName(t.select(F.lit(1).alias("rank"), "pos", F.col("name").alias("label"), "name"))
        return every.groupBy(_ascii_lower(F.col("label")).alias("label")).agg(F.min(F.struct("rank", "pos", "name"))["name"].alias("canonical"))


def resolve_aliases(rows: DataFrame, column: str, ontology: Ontology) -> DataFrame:
    """rows with `canonical`: the entity type that the column names by alias or name, letters' case aside; null if none."""
    names = F.broadcast(ontology.names(rows.sparkSession))  # the schema's size
    return rows.join(names, _ascii_lower(rows[column]) == names["label"], "left").drop("label")


def _property_errors(types: tuple, owner: str) -> Column:
    """The broken property rules of a row (properties as JSON) whose canonical type is in `owner`, in the order of the schema. The schema becomes an expression: no join, no shuffle."""
    keys, doc = F.json_object_keys("properties"), F.try_parse_json("properties")
    out = F.array().cast("array<string>")
    for t in types:
        found = []
        for p in t.properties:
            there = F.coalesce(F.array_contains(keys, F.lit(p.name)), F.lit(False))
            raw = F.try_variant_get(doc, "$['" + p.name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")
            text = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string"))
            if p.required:
                found.append(F.when(~there, F.lit(f"missing required property {p.name} on {t.name}")))
            if p.allowed_values:
                found.append(F.when(there & ~F.coalesce(text, F.lit("")).isin(*p.allowed_values), F.lit(f"property {p.name} value not in allowed set: [{', '.join(p.allowed_values)}]")))
            if p.pattern is not None:
                found.append(F.when(there & text.isNotNull() & ~text.rlike(p.pattern), F.lit(f"property {p.name} does not match pattern {p.pattern}")))
        if found:
            out = F.when(F.col(owner) == t.name, F.array_compact(F.array(*found))).otherwise(out)
    return out


def valid_patterns(ontology: Ontology) -> Ontology:
    """Patterns that are no regular expression check nothing: they are taken out here, so that a job doesn't fail on them."""
    import re

    def ok(p: Property) -> Property:
        try:
            re.compile(p.pattern or "")
            return p
        except re.error:
            return replace(p, pattern=None)

    fix = lambda ts: tuple(replace(t, properties=tuple(map(ok, t.properties))) for t in ts)
    return replace(ontology, entities=fix(ontology.entities), relations=fix(ontology.relations))


def validate_entities(rows: DataFrame, ontology: Ontology, kind: str = "entity_type") -> DataFrame:
    """rows(entity_type, properties as JSON) with canonical, errors (in the order of the schema) and valid. An unknown type is the only error of its row."""
    ontology = valid_patterns(ontology)
    named = resolve_aliases(rows, kind, ontology)
    unknown = F.array(F.format_string("unknown entity type: %s", kind))
    errors = F.when(F.col("canonical").isNull(), unknown).otherwise(_property_errors(ontology.entities, "canonical"))
    return named.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def validate_relations(rows: DataFrame, ontology: Ontology) -> DataFrame:
    """rows(relation_type, source_type, target_type, properties) with canonical, errors and valid. Endpoints are compared without regard to letters' case, and aliases of theirs aren't resolved."""
    ontology = valid_patterns(ontology)
    types = F.broadcast(ontology.relation_types(rows.sparkSession).select(F.col("name").alias("canonical"), "sources", "targets"))  # the schema's size
    named = rows.join(types, _ascii_lower(rows["relation_type"]) == _ascii_lower(F.col("canonical")), "left")
    bad = lambda allowed, got: (F.size(allowed) > 0) & ~F.exists(allowed, lambda x: _ascii_lower(x) == _ascii_lower(F.col(got)))
    ends = F.array_compact(F.array(F.when(bad("sources", "source_type"), F.format_string("relation %s rejects source type %s", "relation_type", "source_type")), F.when(bad("targets", "target_type"), F.format_string("relation %s rejects target type %s", "relation_type", "target_type"))))
    unknown = F.array(F.format_string("unknown relation type: %s", "relation_type"))
    errors = F.when(F.col("canonical").isNull(), unknown).otherwise(F.concat(ends, _property_errors(ontology.relations, "canonical")))
    return named.withColumn("errors", errors).drop("sources", "targets").withColumn("valid", F.size("errors") == 0)


def split_valid(validated: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; not strict: all are accepted, with their errors as warnings."""
    return (validated.where("valid"), validated.where("NOT valid")) if strict else (validated, validated.where(F.lit(False)))


def scoped_types(requested: DataFrame, ontology: Ontology, column: str = "type") -> DataFrame:
    """(pos, name): the requested types (pos, type) as canonical names, unknown ones dropped, repeats kept; all of the ontology if none is requested."""
    spark = requested.sparkSession
    known = resolve_aliases(requested, column, ontology).where("canonical IS NOT NULL").select(F.col("pos").cast("int").alias("pos"), F.col("canonical").alias("name"))
    none = requested.agg(F.count(F.lit(1)).alias("asked")).where("asked = 0")
    return known.unionByName(ontology.entity_types(spark).select("pos", "name").join(F.broadcast(none), how="cross").select("pos", "name"))  # broadcast: one row at most


def _property_list(ontology: Ontology, spark: SparkSession, kind: str) -> DataFrame:
    one = F.format_string("%s (%s%s)", "name", "data_type", F.when(F.col("required"), ", required").otherwise(""))
    p = ontology.properties(spark).where(F.col("kind") == kind)
    return p.groupBy(F.col("owner").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("s")))), lambda x: x["s"]), ", ").alias("props"))


def _line(title: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{title}: "), value))


def entity_prompts(spark: SparkSession, ontology: Ontology) -> DataFrame:
    """(pos, name, prompt): a block of lines on each entity type; empty parts have no line."""
    patterns = F.array_join(F.transform("patterns", lambda p: F.when(p["description"].isNull(), p["pattern"]).otherwise(F.format_string("%s (%s)", p["pattern"], p["description"]))), "; ")
    t = ontology.entity_types(spark).join(_property_list(ontology, spark, "entity"), "name", "left")
    lines = [F.concat(F.lit("Entity type: "), F.col("name")), _line("Description", F.trim("description")), _line("Aliases", F.array_join("aliases", ", ")), _line("Extraction patterns", patterns), _line("Properties", F.col("props"))]
    return t.select("pos", "name", F.concat_ws("\n", *lines).alias("prompt"))


def relation_prompts(spark: SparkSession, ontology: Ontology) -> DataFrame:
    t = ontology.relation_types(spark).join(_property_list(ontology, spark, "relation"), "name", "left")
    lines = [F.concat(F.lit("Relation type: "), F.col("name")), _line("Description", F.trim("description")), _line("Allowed source types", F.array_join("sources", ", ")), _line("Allowed target types", F.array_join("targets", ", ")), _line("Properties", F.col("props"))]
    return t.select("pos", "name", F.concat_ws("\n", *lines).alias("prompt"))


@dataclass
class Registry:
    """Versions of ontologies as rows (seq, name, version, active, json); the last that was registered or activated is a name's active one."""

    rows: list[dict] = field(default_factory=list)

    def register(self, ontology: Ontology, activate: bool = True) -> None:
        if not ontology.version:
            raise ConfigurationError("an ontology needs a version")
        self.rows = [r for r in self.rows if (r["name"], r["version"]) != (ontology.name, ontology.version)]
        self.rows.append({"seq": max((r["seq"] for r in self.rows), default=-1) + 1, "name": ontology.name, "version": ontology.version, "active": False, "json": ontology.to_json()})
        if activate or not any(r["active"] for r in self.rows if r["name"] == ontology.name):
            self.activate(ontology.name, ontology.version)

    def activate(self, name: str, version: str) -> None:
        if version not in self.versions(name):
            raise ConfigurationError(f"{name} has no version {version}")
        for r in self.rows:
            if r["name"] == name:
                r["active"] = r["version"] == version

    def get(self, name: str, version: str | None = None) -> Ontology | None:
        return next((Ontology.from_json(r["json"]) for r in self.rows if r["name"] == name and (r["active"] if version is None else r["version"] == version)), None)

    def versions(self, name: str) -> list[str]:
        return [r["version"] for r in sorted(self.rows, key=lambda r: r["seq"]) if r["name"] == name]

    def names(self) -> list[str]:
        return list(dict.fromkeys(r["name"] for r in sorted(self.rows, key=lambda r: r["seq"])))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r["seq"], r["name"], r["version"], r["active"], r["json"]) for r in self.rows], "seq int, name string, version string, active boolean, json string")


def latest_versions(versions: DataFrame) -> DataFrame:
    """versions(name, version, seq): each name's last."""
    w = Window.partitionBy("name").orderBy(F.desc("seq"))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


SKOS = ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")


def is_equivalence(relation: Column | str = "skos") -> Column:
    return (F.col(relation) if isinstance(relation, str) else relation).isin("exactMatch", "closeMatch")


def usable_alignments(alignments: DataFrame) -> DataFrame:
    """alignments(..., skos, status): those that weren't rejected, with `equivalent`."""
    return alignments.where(F.coalesce(F.col("status"), F.lit("proposed")) != "rejected").withColumn("equivalent", is_equivalence())


def materialize(left: DataFrame, right: DataFrame, strategy: str = "union") -> DataFrame:
    """Type tables (name, ...) of two ontologies as one: all types (the left one's definition first), those of both, or the left ones alone where they overlap in name."""
    if strategy == "intersection":
        return left.join(right.select("name"), "name", "left_semi")
    if strategy in ("union", "precedence"):
        return left.unionByName(right.join(left.select("name"), "name", "left_anti"))
    raise ConfigurationError("strategy must be union, intersection or precedence")
