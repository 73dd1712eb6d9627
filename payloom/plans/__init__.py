"""The control plane: schemas are composed, resolved and compiled on the driver, once for each distinct need."""
