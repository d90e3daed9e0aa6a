x656