from twinweave.sources.catalog import Catalog, as_predicate, pivot_triples
from twinweave.sources.models import load_model, model_params, new_model, save_model
from twinweave.sources.stage import materialise, spread_small, stage_root

__all__ = [
    "Catalog", "as_predicate", "pivot_triples",
    "load_model", "model_params", "new_model", "save_model", "materialise", "spread_small", "stage_root",
]
