"""The plan modules of this subpackage."""

PLANS = [
    "lectern.llm.frequency_plans",
    "lectern.llm.lookalike_plans",
    "lectern.llm.splitting_plans",
    "lectern.llm.token_plans",
    "lectern.llm.stuffing_plans",
]
