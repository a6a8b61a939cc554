"""Relational operators: each takes DataFrames or Columns and returns them; none runs an action unless its docstring says so."""
