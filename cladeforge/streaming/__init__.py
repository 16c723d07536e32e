"""Assignment of arriving sequences to known clusters."""
