x683