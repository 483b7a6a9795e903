"""quillspan: composable DataFrame -> DataFrame operators for large analytical jobs on Spark."""
