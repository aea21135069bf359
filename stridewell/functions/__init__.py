"""Network layers, losses and formats as column expressions."""
