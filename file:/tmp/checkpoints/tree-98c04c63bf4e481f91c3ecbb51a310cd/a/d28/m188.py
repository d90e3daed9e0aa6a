x188