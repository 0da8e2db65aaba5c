"""episcope: find episode data that is well formed but wrong, with plain Spark DataFrame plans."""
