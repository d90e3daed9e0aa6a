x295