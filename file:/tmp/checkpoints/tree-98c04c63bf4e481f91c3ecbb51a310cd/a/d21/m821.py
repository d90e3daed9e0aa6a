x821