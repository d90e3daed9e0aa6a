x495