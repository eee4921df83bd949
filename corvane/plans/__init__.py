"""Named queries over the library's operators."""

from corvane.plans import q_columns, q_joins, q_models, q_reports, q_signal  # noqa: F401
