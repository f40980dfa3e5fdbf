"""Table schemas, options and enumerations of the knowledge-graph model."""

from __future__ import annotations

from dataclasses import dataclass, replace

KNOWLEDGE_BASES = "id string, name string, description string, embed_config struct<provider:string,model:string,base_url:string,dim:int>, llm_config struct<provider:string,model:string,base_url:string>, settings map<string,string>, created_at timestamp"
EPISODES = "id string, kb_id string, content string, source string, metadata map<string,string>, created_at timestamp"
ENTITIES = "id string, kb_id string, name string, type string, summary string, embedding array<float>, created_at timestamp, updated_at timestamp"
RELATIONS = "id string, kb_id string, source_id string, target_id string, type string, summary string, weight double, embedding array<float>, episode_id string, valid_at timestamp, invalid_at timestamp, created_at timestamp"
COMMUNITIES = "id string, kb_id string, name string, summary string, member_ids array<string>, created_at timestamp, updated_at timestamp"
ACCESS_LOG = "kb_id string, entity_type string, entity_id string, accessed_at timestamp"
DECAY_STATE = "kb_id string, entity_type string, entity_id string, strength double, access_count int, last_access timestamp"
FEEDBACK = "id string, kb_id string, topic string, content string, correction string, source string, metadata map<string,string>, created_at timestamp"
JOBS = "id string, kb_id string, status string, content string, source string, metadata map<string,string>, episode_id string, result string, error string, attempts int, max_attempts int, created_at timestamp, started_at timestamp, completed_at timestamp"
SEARCH_RESULT = "id string, kb_id string, type string, content string, score double"

TABLES: dict[str, str] = {
    "knowledge_bases": KNOWLEDGE_BASES,
    "episodes": EPISODES,
    "entities": ENTITIES,
    "relations": RELATIONS,
    "communities": COMMUNITIES,
    "access_log": ACCESS_LOG,
    "decay_state": DECAY_STATE,
    "feedback": FEEDBACK,
    "ingestion_jobs": JOBS,
}

JOB_STATUSES = ("queued", "running", "completed", "failed")
MODES = ("hybrid", "bm25", "vector")
SCORERS = ("bfs", "pagerank", "weighted")
DEFAULT_HALF_LIFE_HOURS = 168.0
DEFAULT_PRUNE_THRESHOLD = 0.05
DEFAULT_CONSOLIDATE_THRESHOLD = 0.92


@dataclass(frozen=True)
class SearchOptions:
    """What a search may set; normalized() applies the limits."""

    top_k: int = 10
    hops: int = 2
    bm25: bool = True
    vector: bool = True
    graph: bool = True
    scorer: str = "bfs"
    edge_types: tuple[str, ...] = ()
    at: str | None = None
    min_weight: float = 0.0
    expand_communities: bool = False
    half_life_hours: float = DEFAULT_HALF_LIFE_HOURS
    #: Apply edge types, time and weight together, not in order of precedence.
    compose_filters: bool = False
    #: Relation hits seed the graph by their ends.
    relation_seeds: bool = False

    @staticmethod
    def of_mode(mode: str, scorer: str = "bfs", **more: object) -> SearchOptions:
        """hybrid, bm25 or vector; the last two leave the graph out. Other names are errors."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
        if scorer not in SCORERS:
            raise ValueError(f"scorer must be one of {', '.join(SCORERS)}, not {scorer!r}")
        return SearchOptions(bm25=mode != "vector", vector=mode != "bm25", graph=mode == "hybrid", scorer=scorer, **more)

    def normalized(self) -> SearchOptions:
        top_k = min(self.top_k if self.top_k > 0 else 10, 1000)
        hops = min(self.hops if self.hops > 0 else 2, 10)
        return replace(self, top_k=top_k, hops=hops)

    @property
    def fetch(self) -> int:
        """Rows that a channel is asked for."""
        return 3 * self.top_k


def page_limit(limit: int | None, default: int = 50, most: int = 1000) -> int:
    """A list's length: the default for none or less than one, and a cap."""
    return default if not limit or limit <= 0 else min(limit, most)
