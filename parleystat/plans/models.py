"""The models of the study."""

from __future__ import annotations

from dataclasses import replace

from parleystat import schemas as S
from parleystat.operators.moments import Model

# Which columns each model uses.
OUTCOMES = ("EMP_Mean", "EMP_1")
CATEGORIES = (S.SEX, S.ETHNICITY)
PERSONALITY = ("extraversion_score", "agreeableness_score")
MEDIATOR = "anthropomorphism_score"
TOKENS = "total_tokens"

_SPEC_CONTROLS = {
    1: ((), ()),
    2: ((), CATEGORIES),
    3: (PERSONALITY, CATEGORIES),
    4: ((*PERSONALITY, TOKENS), CATEGORIES),
}


def regression_models(spec: int) -> list[Model]:
    """One model per outcome. Both outcomes must be present for either."""
    if spec not in _SPEC_CONTROLS:
        raise ValueError(f"unsupported spec {spec}; use 1, 2, 3 or 4")
    controls, categories = _SPEC_CONTROLS[spec]
    numeric = ("condition_avatar", *controls)
    required = ("EMP_Mean", "EMP_1", "condition_avatar", *categories, *controls)
    return [Model(f"spec{spec}", outcome, numeric, categories, required) for outcome in OUTCOMES]


_CONTROLS = (*PERSONALITY, TOKENS)


def total_effect_models() -> list[Model]:
    required = (*OUTCOMES, "condition_avatar", *CATEGORIES, *_CONTROLS)
    return [Model("total_effect", y, ("condition_avatar", *_CONTROLS), CATEGORIES, required) for y in OUTCOMES]


def path_a_models() -> list[Model]:
    required = (MEDIATOR, "condition_avatar", *CATEGORIES, *_CONTROLS)
    return [
        Model("path_a", MEDIATOR, ("condition_avatar", *_CONTROLS), CATEGORIES, required, label="anthropomorphism")
    ]


def full_outcome_models() -> list[Model]:
    numeric = ("condition_avatar", MEDIATOR, *_CONTROLS)
    required = (*OUTCOMES, "condition_avatar", MEDIATOR, *CATEGORIES, *_CONTROLS)
    return [Model("full_outcome", y, numeric, CATEGORIES, required) for y in OUTCOMES]


def mediation_models(common_sample: bool = False) -> list[Model]:
    """The three models, each over its own complete cases, or all over the rows that every one of them can use."""
    models = total_effect_models() + path_a_models() + full_outcome_models()
    if not common_sample:
        return models
    shared = tuple(dict.fromkeys(c for m in models for c in m.required))
    return [replace(m, required=shared) for m in models]
