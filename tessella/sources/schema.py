"""The catalog's model: relations, attributes, indices; merging, text and JSON forms."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from tessella.errors import UnknownRelation

log = logging.getLogger(__name__)

INTEGER, CHAR = "Integer", "Char"


@dataclass
class Attribute:
    name: str
    type: str
    length: int = 0
    not_null: bool = True

    def field(self) -> T.StructField:
        kind = T.IntegerType() if self.type == INTEGER else T.StringType()
        return T.StructField(self.name, kind, not self.not_null, {"len": self.length} if self.type == CHAR else {})


@dataclass
class Index:
    attribute: str
    segment: int = 0


@dataclass
class Relation:
    name: str
    segment: int = 0
    attributes: list[Attribute] = field(default_factory=list)
    indices: list[Index] = field(default_factory=list)
    primary_key: list[int] = field(default_factory=list)

    def struct(self) -> T.StructType:
        return T.StructType([a.field() for a in self.attributes])


@dataclass
class Schema:
    """Relations in order; equality is structural and regards order."""

    relations: list[Relation] = field(default_factory=list)

    def relation(self, name: str) -> Relation:
        for r in self.relations:
            if r.name == name:
                return r
        raise UnknownRelation(f"no relation {name!r}")

    def relation_of_segment(self, segment: int) -> Relation:
        for r in self.relations:
            if r.segment == segment:
                return r
        raise UnknownRelation(f"no relation has segment {segment}")

    def index_segment(self, relation: str, attribute: str) -> int:
        for i in self.relation(relation).indices:
            if i.attribute == attribute:
                return i.segment
        raise UnknownRelation(f"{relation} has no index on {attribute!r}")

    def merge(self, other: Schema) -> list[str]:
        """Take over relations of new names, with the lowest free segment ids from 1 on: a
        relation's first, then its indices'. Names that are there are skipped and returned."""
        used = {s for r in self.relations for s in (r.segment, *(i.segment for i in r.indices))}
        skipped = []

        def free() -> int:
            segment = next(s for s in range(1, len(used) + 2) if s not in used)
            used.add(segment)
            return segment

        known = {r.name for r in self.relations}
        for r in other.relations:
            if r.name in known:
                log.error("relation %s exists already and is skipped", r.name)
                skipped.append(r.name)
                continue
            known.add(r.name)
            segment = free()
            indices = [Index(i.attribute, free()) for i in r.indices]
            self.relations.append(Relation(r.name, segment, [Attribute(**asdict(a)) for a in r.attributes], indices, list(r.primary_key)))
        return skipped

    def to_text(self) -> str:
        out = []
        for r in self.relations:
            out.append(f"{r.name} (segment {r.segment})")
            out.append("  primary key: " + (", ".join(r.attributes[k].name for k in r.primary_key) or "none"))
            for a in r.attributes:
                kind = a.type if a.type == INTEGER else f"{a.type}({a.length})"
                out.append(f"  {a.name} {kind}" + " not null" * a.not_null)
            out += [f"  index on {i.attribute} (segment {i.segment})" for i in r.indices]
        return "\n".join(out)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        return cls(
            [
                Relation(r["name"], r["segment"], [Attribute(**a) for a in r["attributes"]], [Index(**i) for i in r["indices"]], r["primary_key"])
                for r in json.loads(text)["relations"]
            ]
        )
