x525