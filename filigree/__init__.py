"""filigree: code-graph analytics and data processing as Spark DataFrame programs.

Every operator takes DataFrames and returns DataFrames; nothing holds hidden
state.  ``filigree.llm`` is an optional subpackage that nothing else imports.
"""

__version__ = "0.1.0"
