"""DataFrame -> DataFrame operators. They run no actions, so batch jobs and micro-batches share them."""
