x189