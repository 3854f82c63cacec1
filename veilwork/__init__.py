"""veilwork: find, mask and verify personal data with Spark.

Everything is a plain ``Column -> Column`` or ``DataFrame -> DataFrame``
function; nothing here holds a session or any other state.
"""
