"""All registered queries of the library."""

from lodestone.plans import audit_queries, case_queries, etl_queries, file_queries, noise_queries, question_queries, retrieval_queries, review_queries, scalar_queries, template_queries  # noqa: F401
from lodestone.plans.registry import QUERIES, SQL  # noqa: F401
