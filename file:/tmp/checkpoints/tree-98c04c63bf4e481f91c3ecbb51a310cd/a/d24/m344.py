x344