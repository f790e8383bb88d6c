"""All queries of the subpackage; importing this module registers them."""

from tallyframe.llm import q_corpus, q_data, q_native, q_text  # noqa: F401
from tallyframe.llm.base import QUERIES, SQL  # noqa: F401
