x430