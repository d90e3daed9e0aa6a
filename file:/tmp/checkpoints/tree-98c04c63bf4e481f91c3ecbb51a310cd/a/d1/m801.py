x801