"""Imports every module that registers queries."""

from lodestone.operators import q_plan  # noqa: F401
from lodestone.operators import q_documents, q_files, q_more, q_profile, q_relations, q_search, q_streaming  # noqa: F401
from lodestone.operators import q_names  # noqa: F401
from lodestone.operators import q_lifecycle  # noqa: F401
from lodestone.operators import q_structure  # noqa: F401
from lodestone.operators import q_inputs  # noqa: F401
from lodestone.operators import q_sheets  # noqa: F401
