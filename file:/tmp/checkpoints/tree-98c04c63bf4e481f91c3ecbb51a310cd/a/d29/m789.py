x789