"""Where captures and model runs come from and go to."""
