"""State transitions and data-quality checks as pure DataFrame functions.

Plain Parquet tables support neither MERGE nor DELETE, so every transition
is ``(state, batch, as_of) -> new_state`` built from joins; persistence
(writing a new version, switching a pointer) lives in ``sources.store``.
"""
