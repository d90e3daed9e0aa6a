x873