"""Training-data operators. Nothing outside this folder imports it; `registry` lists its queries."""
