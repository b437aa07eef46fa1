"""A dataset: an immutable base table and a replayable list of cleaning actions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession

from tabulon.errors import AnalysisError
from tabulon.functions.columns import normalize_missing, resolve_columns
from tabulon.operators.actions import ACTIONS, apply_action, replace_missing, validate_actions
from tabulon.sources.writers import delete_folder, folder_exists, read_json_document, write_json_document


@dataclass(frozen=True)
class ColumnMeta:
    """What is known of a column beside its values."""

    # The field names and the measures.
    label: str = ""
    measure: str = "scale"
    value_labels: Mapping[str, str] = field(default_factory=dict)
    missing_codes: Sequence[Any] = ()

    MEASURES: ClassVar = ("scale", "nominal", "ordinal")

    def __post_init__(self):
        if self.measure not in self.MEASURES:
            raise AnalysisError("unknown_measure", f"{self.measure!r} is none of {', '.join(self.MEASURES)}")

    def as_dict(self) -> dict[str, Any]:
        return {"label": self.label, "measure": self.measure, "value_labels": dict(self.value_labels),
                "missing_codes": list(self.missing_codes)}


class Dataset:
    """``raw`` plus ``actions[:cursor]``. The current table is a lazy plan over ``raw``; nothing is copied.

    Column metadata is kept under the column's original name and follows renames.
    """

    def __init__(self, raw: DataFrame, actions: Sequence[Mapping[str, Any]] = (), cursor: int | None = None,
                 meta: Mapping[str, Mapping[str, Any]] | None = None, order_by: Sequence[str] = ()):
        validate_actions(list(actions), limit=None)
        self._stored: tuple[str, str] | None = None  # where the raw table lies: folder of the dataset, folder in it
        self.raw = normalize_missing(raw)
        self.actions = [dict(a) for a in actions]
        self.cursor = len(self.actions) if cursor is None else max(0, min(int(cursor), len(self.actions)))
        self.meta = {k: dict(v) for k, v in (meta or {}).items()}
        self.order_by = list(order_by)
        self._tables = [self.raw]  # the plan after 0, 1, 2, ... actions, as far as it was asked for
        self._facts: list[dict[str, Any]] = []  # what each of these actions has read of the data

    # -- the current table ------------------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        """The raw table after the first ``cursor`` actions, with column metadata attached."""
        # Numbers that an action computed from the data (a mean, a quantile) are literals of its plan: no action is resolved twice.
        for i in range(len(self._tables) - 1, self.cursor):
            if i == len(self._facts):
                self._facts.append({})
            self._tables.append(normalize_missing(apply_action(
                self._tables[-1], self.actions[i], order_by=self.order_by, facts=self._facts[i])))
        table = self._tables[self.cursor]
        for original, current in self.current_names().items():
            if original in self.meta and current in table.columns:
                table = table.withMetadata(current, {**table.schema[current].metadata, **self.meta[original]})
        return table

    def apply(self, *actions: Mapping[str, Any]) -> Dataset:
        """Add actions after the cursor; whatever could have been redone is gone."""
        validate_actions(list(actions))
        kept = [*self.actions[:self.cursor], *[dict(a) for a in actions]]
        after = self._with(actions=kept, cursor=len(kept))
        after.df  # an action that does not fit the data fails here, and this dataset stays as it is
        return after

    def undo(self) -> Dataset:
        return self.jump(self.cursor - 1)

    def redo(self) -> Dataset:
        return self.jump(self.cursor + 1)

    def jump(self, cursor: int) -> Dataset:
        return self._with(cursor=max(0, min(int(cursor), len(self.actions))))

    def history(self) -> dict[str, Any]:
        return {"cursor": self.cursor, "total": len(self.actions), "can_undo": self.cursor > 0,
                "can_redo": self.cursor < len(self.actions)}

    def _with(self, **changes: Any) -> Dataset:
        state = {"actions": self.actions, "cursor": self.cursor, "meta": self.meta, "order_by": self.order_by}
        copy = Dataset.__new__(Dataset)
        copy.__dict__.update(raw=self.raw, _stored=self._stored, **{**state, **changes})
        same = next((i for i, (a, b) in enumerate(zip(copy.actions, self.actions)) if a != b), min(len(copy.actions), len(self.actions)))
        copy._tables, copy._facts = self._tables[:same + 1], self._facts[:same]
        return copy

    def new_baseline(self, df: DataFrame) -> Dataset:
        """A fresh dataset on another table: no actions, no metadata."""
        return Dataset(df, order_by=[c for c in self.order_by if c in df.columns])

    def transform(self, function: Callable[[DataFrame], DataFrame]) -> Dataset:
        """Run a trusted function of the current table; a changed plan becomes the new baseline."""
        before = self.df
        after = function(before)
        if not isinstance(after, DataFrame):
            raise AnalysisError("not_a_table", "the function must return a DataFrame")
        return self if after is before or after.sameSemantics(before) and after.columns == before.columns \
            else self.new_baseline(after)

    # -- column metadata --------------------------------------------------------------------

    def current_names(self) -> dict[str, str]:
        """Original column name to current name, through the renames and drops up to the cursor."""
        names = {c: c for c in self.raw.columns}
        for action in self.actions[:self.cursor]:
            params = action.get("params") or {}
            present = list(names.values())
            if action["type"] == "rename_columns":
                new = {}
                for old, target in (params.get("mapping") or {}).items():
                    match = resolve_columns([old], present) if target else []
                    if match:
                        new[match[0]] = str(target)
                names = {o: new.get(c, c) for o, c in names.items()}
            elif action["type"] in ("drop_columns", "one_hot_encode"):
                gone = set(resolve_columns(params.get("columns") or [], present))
                names = {o: c for o, c in names.items() if c not in gone}
        return names

    def set_column_meta(self, column: str, *, label: str = "", measure: str = "scale",
                        value_labels: Mapping[str, str] | None = None, missing_codes: Sequence[Any] = ()) -> Dataset:
        """Describe a column by its current name."""
        original = next((o for o, c in self.current_names().items() if c == column), column)
        entry = ColumnMeta(label, measure.strip().lower(), value_labels or {}, missing_codes)
        return self._with(meta={**self.meta, original: entry.as_dict()})

    def column_meta(self) -> dict[str, dict[str, Any]]:
        """Metadata of the current columns, by current name."""
        known = {current: self.meta[original] for original, current in self.current_names().items() if original in self.meta}
        return {c: ColumnMeta(**known.get(c, {})).as_dict() for c in self.df.columns}

    def apply_missing_codes(self, columns: Sequence[str] = ()) -> Dataset:
        """Turn the recorded missing codes of the columns (of all, by default) into missing cells."""
        meta = self.column_meta()
        names = resolve_columns(columns, meta) if columns else list(meta)
        steps = [{"type": replace_missing.__name__, "params": {"columns": [c], "values": meta[c]["missing_codes"]}}
                 for c in names if meta[c]["missing_codes"]]
        return self.apply(*steps) if steps else self

    # -- storage ----------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """The raw table as Parquet and the recipe as JSON. The current table is replayed, not stored.

        The raw table never changes, so it is written only where it does not lie already, each time to a folder of its own. Recipes
        are numbered folders of one file each, which appears as a whole or not at all; the one with the highest number counts, and the
        others go only after it is there. So a save that breaks off anywhere leaves a state that loads. What the actions have read of
        the data (means, quantiles, levels) is stored with them.
        """
        path = path.rstrip("/")
        spark = self.raw.sparkSession
        if self._stored is None or self._stored[0] != path:
            folder = f"raw-{uuid.uuid4().hex}"
            self.raw.write.parquet(f"{path}/{folder}")
            self._stored = (path, folder)
        recipe = {"version": 3, "raw": self._stored[1], "actions": self.actions, "cursor": self.cursor, "meta": self.meta,
                  "order_by": self.order_by, "facts": self._facts}
        older = [number for number, _ in _recipes(spark, path)]
        write_json_document(spark, recipe, f"{path}/recipes/number={max(older, default=-1) + 1}")
        for number in older:
            delete_folder(spark, f"{path}/recipes/number={number}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dataset:
        """The dataset of the newest recipe; no action reads the data again whose facts were stored."""
        path = path.rstrip("/")
        found = _recipes(spark, path)
        recipe = json.loads(max(found)[1]) if found else read_json_document(spark, f"{path}/recipe")
        folder = recipe.get("raw", "raw")
        data = Dataset(spark.read.parquet(f"{path}/{folder}"), recipe["actions"], recipe["cursor"], recipe["meta"],
                       recipe["order_by"])
        data._facts = recipe.get("facts", [])
        data._stored = (path, folder)
        return data


def _recipes(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and text of each recipe of a saved dataset."""
    if not folder_exists(spark, f"{path}/recipes"):
        return []
    return [(r.number, r.value) for r in spark.read.schema("value string, number long").text(f"{path}/recipes").collect()]


SUPPORTED_ACTIONS = tuple(ACTIONS)
