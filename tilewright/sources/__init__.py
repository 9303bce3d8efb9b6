"""Where slides, images and records come from and go to."""
