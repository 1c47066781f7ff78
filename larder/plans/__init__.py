"""Versioned stores: multi-step jobs around a pointer that is swapped last."""
