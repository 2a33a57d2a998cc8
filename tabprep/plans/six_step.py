"""The standard preparation: missing values, outlier flags, log, scaling, encoding, collinearity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from tabprep.operators.collinear import MulticollinearityReducer
from tabprep.operators.distribution import LogSelector
from tabprep.operators.encoding import CategoricalEncoder
from tabprep.operators.missing import MissingValueHandler
from tabprep.operators.outliers import simple_bounds
from tabprep.operators.scaling import FeatureScaler
from tabprep.plans.chain import StepChain

STEPS = ("missing_handler", "outlier_detector", "log_transformer", "scaler", "encoder",
         "multicollinearity_reducer")


def six_step_chain(ordinal_features_map: Mapping[str, Sequence[str]] | None = None,
                   iqr_factor: float = 1.5, vif_threshold: float = 5.0, one_hot: str = "auto") -> StepChain:
    settings = (
        MissingValueHandler(drop_high_missing_threshold=0.3, strictly_above=True),
        simple_bounds("iqr", iqr_factor),
        LogSelector(),
        FeatureScaler("standard", in_place=True, min_std=1e-9),
        CategoricalEncoder(ordinal_features_map=ordinal_features_map or {}, max_cardinality=None,
                           two_values_are_binary=False, one_hot_last=True, one_hot=one_hot),
        MulticollinearityReducer(vif_threshold, max_iter=None, drop_constant_first=True),
    )
    return StepChain(list(zip(STEPS, settings, strict=True)))
