"""Settings of cleaning, filtering and modelling.

The nested dictionary form (``paths``, ``data_source``,
``preprocessing.cleaning``, ``preprocessing.filters``) is accepted as is.
"""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field, fields
from typing import Any

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Cleaning:
    profile: str = "default"
    markdown_removal: bool = True
    unescape: bool = False
    url_removal: bool = False
    html_tag_removal: bool = False
    quote_normalization: bool = False
    html_entity_removal: bool = False
    char_filtering: bool = False
    char_filter_regex: str | None = None
    lowercase: bool = False

    def __post_init__(self) -> None:
        if self.profile not in ("default", "forum_v1"):
            raise ValueError(f"unknown cleaning profile {self.profile!r}")

    @classmethod
    def from_dict(cls, d: dict[str, Any] | None) -> Cleaning:
        """Keys may be bare, ``apply_x`` or ``clean_apply_x``."""
        known = {f.name for f in fields(cls)}
        out: dict[str, Any] = {}
        for key, value in (d or {}).items():
            name = key.removeprefix("clean_").removeprefix("apply_")
            if name not in known:
                raise ValueError(f"unknown cleaning setting {key!r}")
            out[name] = value
        return cls(**out)


@dataclass(frozen=True)
class Filters:
    length_filter: bool = False
    min_doc_length: int | None = 0
    max_doc_length: int | None = None
    duplicate_removal: bool = False
    column_for_duplicate_checking: str = "docs"
    score_filter: bool = False
    score_column_for_filtering: str | None = None
    min_score_for_filtering: float | None = None
    max_score_for_filtering: float | None = None

    @classmethod
    def from_dict(cls, d: dict[str, Any] | None) -> Filters:
        known = {f.name for f in fields(cls)}
        out: dict[str, Any] = {}
        for key, value in (d or {}).items():
            name = key.removeprefix("apply_")
            if name not in known:
                raise ValueError(f"unknown filter setting {key!r}")
            out[name] = value
        return cls(**out)


@dataclass(frozen=True)
class DataSource:
    text_source_columns: tuple[str, ...] = ("text",)
    unique_id_column: str = "id"
    required_columns_for_docs_creation: tuple[str, ...] = ()
    null_token: str = ""

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> DataSource:
        d = {k: v for k, v in d.items() if k != "data_type_specific_df_processing"}
        for key in ("text_source_columns", "required_columns_for_docs_creation"):
            if key in d:
                d[key] = tuple(d[key])
        return cls(**d)


@dataclass(frozen=True)
class Preprocessing:
    source: DataSource = field(default_factory=DataSource)
    cleaning: Cleaning = field(default_factory=Cleaning)
    filters: Filters = field(default_factory=Filters)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Preprocessing:
        pre = d.get("preprocessing", {})
        return cls(
            DataSource.from_dict(d.get("data_source", {})),
            Cleaning.from_dict(pre.get("cleaning")),
            Filters.from_dict(pre.get("filters")),
        )


@dataclass(frozen=True)
class Clustering:
    """A bad value raises; nothing falls back silently."""

    min_cluster_size: int = 15
    min_samples: int | None = None
    selection: str = "eom"
    epsilon: float = 0.0
    #: points of a leaf, within which neighbours are exact; projection trees; steps of distance per doubling
    leaf_size: int = 2048
    trees: int = 4
    resolution: int = 8

    def __post_init__(self) -> None:
        if self.min_cluster_size < 2:
            raise ValueError("min_cluster_size must be at least 2")
        if self.min_samples is not None and self.min_samples < 1:
            raise ValueError("min_samples must be at least 1")
        if self.selection not in ("eom", "leaf"):
            raise ValueError("selection must be 'eom' or 'leaf'")
        if self.epsilon < 0:
            raise ValueError("epsilon must not be negative")
        if min(self.leaf_size, self.trees, self.resolution) < 1:
            raise ValueError("leaf_size, trees and resolution must be positive")


@dataclass(frozen=True)
class Modeling:
    n_components: int = 5
    clustering: Clustering = field(default_factory=Clustering)
    min_topic_size: int = 10
    nr_topics: int | None = None
    top_n_words: int = 10
    ngram_range: tuple[int, int] = (1, 1)
    stop_words: str | tuple[str, ...] | None = "english"
    min_frequency: int = 1
    linkage: str = "ward"
    #: steps that re-rank topic words, see :func:`operators.represent.aspect_steps`
    representation: Any = None

    def __post_init__(self) -> None:
        if self.n_components < 1 or self.top_n_words < 1 or self.min_topic_size < 1:
            raise ValueError("n_components, top_n_words and min_topic_size must be positive")
        lo, hi = self.ngram_range
        if not 1 <= lo <= hi:
            raise ValueError("ngram_range must be (lo, hi) with 1 <= lo <= hi")
        if self.nr_topics is not None and self.nr_topics < 1:
            raise ValueError("nr_topics must be positive")

    @classmethod
    def from_dict(cls, d: dict[str, Any] | None) -> Modeling:
        """Own names, or component settings in groups named ``*_params``, or both; own names go first.

        A setting of a component that has no part here is logged; one that
        nobody knows raises, and so does a group that is no dictionary.
        """
        own = {f.name for f in fields(cls)}
        out: dict[str, Any] = {}
        clustering: dict[str, Any] = {}
        for group, values in (d or {}).items():
            if not group.endswith("_params"):
                continue
            if group == "representation_params":
                out["representation"] = values
                continue
            if values is None:
                continue
            if not isinstance(values, dict):
                raise ValueError(f"{group} must be a dictionary, not {type(values).__name__}")
            for key, value in values.items():
                if key in WITHOUT_PART:
                    log.warning("setting %s.%s has no part in this model", group, key)
                elif key in CLUSTERING_NAMES:
                    clustering[CLUSTERING_NAMES[key]] = value
                elif key in MODELING_NAMES:
                    out[MODELING_NAMES[key]] = value
                else:
                    raise ValueError(f"unknown setting {group}.{key}")
        plain = {k: v for k, v in (d or {}).items() if not k.endswith("_params")}
        given = plain.pop("clustering", {})
        if not isinstance(given, dict):
            raise ValueError("clustering must be a dictionary")
        clustering |= given
        out |= plain
        for key in out:
            if key not in own:
                raise ValueError(f"unknown setting {key!r}")
        for key in clustering:
            if key not in {f.name for f in fields(Clustering)}:
                raise ValueError(f"unknown setting clustering.{key}")
        if "ngram_range" in out:
            out["ngram_range"] = tuple(out["ngram_range"])
        if isinstance(out.get("stop_words"), list):
            out["stop_words"] = tuple(out["stop_words"])
        return cls(clustering=Clustering(**clustering), **out)


# Names that settings of components have elsewhere, and what they are here.
CLUSTERING_NAMES = {
    "min_cluster_size": "min_cluster_size",
    "min_samples": "min_samples",
    "cluster_selection_method": "selection",
    "cluster_selection_epsilon": "epsilon",
}
MODELING_NAMES = {
    "n_components": "n_components",
    "ngram_range": "ngram_range",
    "n_gram_range": "ngram_range",
    "stop_words": "stop_words",
    "min_df": "min_frequency",
    "top_n_words": "top_n_words",
    "min_topic_size": "min_topic_size",
    "nr_topics": "nr_topics",
}
WITHOUT_PART = frozenset(
    "n_neighbors min_dist spread metric random_state n_jobs low_memory verbose language calculate_probabilities "
    "prediction_data gen_min_span_tree core_dist_n_jobs algorithm leaf_size approx_min_span_tree".split()
)


def to_json(config: Any) -> str:
    """A stable JSON form of a settings object or dictionary."""
    return json.dumps(config if isinstance(config, dict) else asdict(config), sort_keys=True)
